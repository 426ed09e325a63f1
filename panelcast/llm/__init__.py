"""Operators for preparing training text at cluster scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` holds the thin registered queries.
"""
