"""Selections as sparse rows: codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import NAMES


def codes(spark) -> DataFrame:
    """Code 1 to 24 of each transform: the 12 plain ones, then the detrended."""
    names = list(NAMES.values()) + [f"{n}_detrended" for n in NAMES.values()]
    return spark.createDataFrame(list(enumerate(names, 1)), "code int, transform string")


def selection_codes(selection: DataFrame, bases: DataFrame) -> DataFrame:
    """``panel_id, window_id, base, code``: the lowest code of the transforms selected, 0 if none; every window of a panel has all its bases."""
    coded = selection.join(F.broadcast(codes(selection.sparkSession)), "transform").groupBy("panel_id", "window_id", "base").agg(F.min("code").alias("code"))  # 24 rows
    windows = selection.select("panel_id", "window_id").distinct()
    grid = windows.join(bases.select("panel_id", "base").distinct(), "panel_id")
    return grid.join(coded, ["panel_id", "window_id", "base"], "left").withColumn("code", F.coalesce("code", F.lit(0)))
