"""Batch jobs on Spark for forecasting large panels of time series."""
