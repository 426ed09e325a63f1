"""Evaluation of stored errors by sample: scores, comparison with the benchmark, test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.calendar import split_sample


def evaluate(errors: DataFrame, crisis: DataFrame, benchmark: str = "arp") -> DataFrame:
    """``part, panel_id, model, target, h, mse, relative, t, p`` for the full sample, crisis months and the rest."""
    out = None
    for part in ("full", "crisis", "non-crisis"):
        rows = split_sample(errors, crisis, part)
        one = E.mse(rows).join(E.relative_mse(rows, benchmark), list(E.UNIT), "left")
        one = one.join(E.dm_test(rows, benchmark).select(*E.UNIT, "t", "p"), list(E.UNIT), "left").withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out
