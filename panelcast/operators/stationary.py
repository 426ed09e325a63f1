"""Unit-root tests by series and what they keep; model confidence sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import KEYS, by_date, whole
from ..kernels import inference as K
from .evaluate import bootstrap_mean, phillips_perron
from .spread import dealt


def _lag_moments(obs: DataFrame, most: int, fixed: int | None) -> DataFrame:
    """``panel_id, series, most, rows, sums``: sums of products of (1, difference, level before, differences before) by series.

    Every lag up to ``most`` is compared on the same rows; a short series has fewer lags, and products beyond are 0.
    One sort of the series gives the lags, one aggregate the sums; levels are taken less their mean against cancellation.
    """
    y = F.col("value") - F.avg("value").over(whole())
    seen = obs.where("value is not null").select(*KEYS, "ds", y.alias("y"), F.count("value").over(whole()).alias("n"), F.row_number().over(by_date()).alias("i"))
    lags = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / 3).cast("int") - 2)) if fixed is None else F.lit(fixed)
    seen = seen.withColumns({"most": lags.cast("int"), "level": F.lag("y", 1).over(by_date()), "d": F.col("y") - F.lag("y", 1).over(by_date())})
    past = {f"d{k}": F.when(F.col("most") >= k, F.lag("d", k).over(by_date())).otherwise(0.0) for k in range(1, most + 1)}
    rows = seen.withColumns(past).where(F.col("i") - 2 >= F.col("most"))
    names = ["d", "level", *past]
    sums = [F.sum(c) for c in names] + [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    made = rows.groupBy(*KEYS).agg(F.first("most").alias("most"), F.count(F.lit(1)).cast("int").alias("rows"), F.array(*sums).alias("sums"))
    return obs.select(*KEYS).distinct().join(made, list(KEYS), "left")


def adf(obs: DataFrame, most: int = 10, ic: str = "bic", fixed: int | None = None) -> DataFrame:
    """``panel_id, series, t, lag, n, critical``: the augmented Dickey-Fuller t with a constant, its lag by criterion or ``fixed``.

    Lagged products are summed by series on Spark; a batch of thousands of series is then solved at once.  A series too
    short for a regression has no t and 0 rows.
    """
    most = most if fixed is None else fixed
    k = most + 3

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [(i, j) for i in range(1, k) for j in range(i, k)]
        for batch in batches:
            rows = np.array([r or 0 for r in batch.column(3).to_pylist()])
            sums = np.array([s or [0.0] * (k - 1 + len(upper)) for s in batch.column(4).to_pylist()]).reshape(len(rows), -1)
            m = np.zeros((len(rows), k, k))
            m[:, 0, 0] = rows
            m[:, 0, 1:] = m[:, 1:, 0] = sums[:, : k - 1]
            for c, (i, j) in enumerate(upper):
                m[:, i, j] = m[:, j, i] = sums[:, k - 1 + c]
            t, lag, found = K.adf_from_moments(m, rows, np.array([v or 0 for v in batch.column(2).to_pylist()]), ic, fixed)
            n = np.where(found, rows, 0)
            cols = [batch.column(0), batch.column(1), pa.array(t, from_pandas=True), pa.array(lag, pa.int32()), pa.array(n, pa.int32()), pa.array([K.critical(max(int(v), 1)) for v in n], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["panel_id", "series", "t", "lag", "n", "critical"])

    return _lag_moments(obs, most, fixed).mapInArrow(solve, "panel_id string, series string, t double, lag int, n int, critical double")


def stationary_series(obs: DataFrame, mode: str = "both") -> DataFrame:
    """``stationary`` by series: both tests reject a unit root, or the one named (adf, pp)."""
    a = adf(obs).select(*KEYS, (F.col("t") < F.col("critical")).alias("adf"))
    p = phillips_perron(obs).select(*KEYS, (F.col("z_t") < F.col("critical")).alias("pp"))
    both = a.join(p, list(KEYS))
    rule = {"both": F.col("adf") & F.col("pp"), "adf": F.col("adf"), "pp": F.col("pp")}[mode]
    return both.withColumn("stationary", F.coalesce(rule, F.lit(False)))


def keep_stationary(obs: DataFrame, mode: str = "both") -> tuple[DataFrame, DataFrame]:
    """The rows of stationary series, and the list of the others."""
    verdict = stationary_series(obs, mode)
    return obs.join(verdict.where("stationary"), list(KEYS), "left_semi"), verdict.where("not stationary").select(*KEYS)


def confidence_set(errors: DataFrame, alpha: float = 0.1, draws: int = 200, width: int = 6, statistic: str = "R") -> DataFrame:
    """``place, model, p, kept`` for each panel, target and horizon, from squared errors.

    Dates that lack a model are left out.  A model's losses are an array of its unit, and each draw is a fold
    over it, so nothing is joined; only draws x models numbers of a unit meet in a task.
    """
    by = ["panel_id", "target", "h"]
    models = errors.groupBy(*by).agg(F.count_distinct("model").alias("models"))
    days = errors.groupBy(*by, "ds").agg(F.count_distinct("model").alias("here")).join(models, by).where("here = models").select(*by, "ds")
    losses = F.array_sort(F.collect_list(F.struct("ds", (F.col("err") ** 2).alias("loss"))))
    arrays = errors.join(days, [*by, "ds"], "left_semi").groupBy(*by, "model").agg(losses.alias("v")).select(*by, "model", F.col("v.loss").alias("v"))
    point = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    drawn = arrays.withColumn("b", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(draws - 1).cast("long"))))
    every = drawn.select(*by, "model", "b", F.when(F.col("b") < 0, point).otherwise(bootstrap_mean(F.col("v"), F.col("b"), width, "stationary")).alias("m"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="b", columns="model", values="m").sort_index()
        order, p = K.confidence_set(wide.loc[-1].to_numpy(float), wide.drop(index=-1).dropna().to_numpy(float), statistic)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["panel_id"], first["target"], first["h"], k + 1, wide.columns[i], float(q), bool(q >= alpha)) for k, (i, q) in enumerate(zip(order, p))], columns=["panel_id", "target", "h", "place", "model", "p", "kept"])

    return dealt(every, *by).groupBy(*by).applyInPandas(each, "panel_id string, target string, h int, place int, model string, p double, kept boolean")

