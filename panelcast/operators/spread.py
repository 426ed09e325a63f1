"""Groups that are small in bytes and long in work get tasks of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.transforms import KEYS


def tasks(df: DataFrame) -> int:
    """Four tasks a core, or the session's shuffle partitions where these are more."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over a given number of partitions, which adaptive execution doesn't merge; grouping by them needs no further shuffle."""
    return df.repartition(tasks(df), *keys)


def each_series(df: DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``each`` of every series, its rows in order of ``ds``.

    Series are dealt over tasks and sorted there; a task goes through its rows by Arrow batches, which hold many short
    series each, so a series costs no call of its own between Spark and Python, and memory holds a batch and one series.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = np.logical_and.reduce([(pdf[k] == pdf[k].iat[-1]) | (pdf[k].isna() & pd.isna(pdf[k].iat[-1])) for k in KEYS])
            ready, rest = pdf[~last], pdf[last]
            made = [each(one) for _, one in ready.groupby(list(KEYS), sort=False, dropna=False)]
            if made:
                yield pd.concat(made, ignore_index=True)
        if rest is not None:
            yield each(rest)

    return dealt(df, *KEYS).sortWithinPartitions(*KEYS, "ds").mapInPandas(run, schema)


def each_batch(df: DataFrame, each: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """As ``each_series``, for work that takes many series at once: ``each`` has a table of whole series and the rows at which they start."""

    def changes(rows: pa.Table) -> np.ndarray:
        moved = np.zeros(max(len(rows) - 1, 0), bool)
        for k in KEYS:
            c = rows[k].combine_chunks()
            a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
            moved |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        return np.flatnonzero(moved) + 1

    def made(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(parts)
        yield from each(rows, np.r_[0, changes(rows)]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            at = changes(rows)
            if len(at):
                yield from made([*held, rows.slice(0, at[-1])])
                held = [rows.slice(at[-1])]
            elif held and len(changes(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), rows.slice(0, 1)]))):
                yield from made(held)
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield from made(held)

    return dealt(df, *KEYS).sortWithinPartitions(*KEYS, "ds").mapInArrow(run, schema)
