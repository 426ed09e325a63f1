"""Series names: cleaning, base and suffix, targets; state as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, "[ &:]", "")


def base_name(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(c, "_", 1)


def suffix(c: Column) -> Column:
    return F.regexp_replace(c, "^[^_]*_", "")


def horizon_of(c: Column) -> Column:
    """The number in a label such as ``h12``."""
    return F.regexp_extract(c, "[0-9]+", 0).cast("int")


def resolve_targets(known: DataFrame, targets: list[str]) -> DataFrame:
    """``target, name`` for base names of ``known(base, name)``; ``["all"]`` takes every one, unknown names are an error."""
    if targets == ["all"]:
        return known.select(F.col("base").alias("target"), "name")
    wanted = known.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    unknown = [r.target for r in wanted.join(known, wanted.target == known.base, "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown targets: {sorted(unknown)}")
    return wanted.join(known, wanted.target == known.base).select("target", "name")


def state_round_trip(state: DataFrame) -> DataFrame:
    """Rows written as JSON and read back with their schema."""
    as_json = state.select(F.to_json(F.struct(*state.columns)).alias("j"))
    return as_json.select(F.from_json("j", state.schema).alias("s")).select("s.*")
