"""Forests and boosted trees on the pooled panel: one MLlib fit serves many series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import by_date, KEYS
from ..sources.io import cut
from .factors import factors_at
from .features import lag_features

FORECAST = "panel_id string, model string, target string, h int, origin_ds date, target_ds date, y_true double, y_pred double, err double"


def pooled_features(obs: DataFrame, h: int, lags: int = 4) -> DataFrame:
    """Rows with the value and its lags, the mean of the panel, and ``y`` = the value h steps later."""
    rows = lag_features(obs, lags).withColumn("y", F.lead("value", h).over(by_date())).withColumn("target_ds", F.lead("ds", h).over(by_date()))
    return rows.withColumn("panel_mean", F.avg("value").over(Window.partitionBy("panel_id", "ds")))


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*KEYS, "ds", "y", "target_ds", "window_id")]


POOLED: dict[str, Callable] = {}


def pooled(name: str) -> Callable:
    """Registers ``fit(rows, **options)`` for models of many series at once: ``rows(x, y)`` gives something whose ``transform`` adds ``prediction``."""

    def put(f: Callable) -> Callable:
        POOLED[name] = f
        return f

    return put


def learner(kind: str, trees: int, seed: int = 7):
    common = {"featuresCol": "x", "labelCol": "y", "seed": seed}
    if kind == "boosted":
        return GBTRegressor(maxIter=trees, maxDepth=3, **common)
    return RandomForestRegressor(numTrees=trees, maxDepth=6, featureSubsetStrategy="all" if kind == "bagged" else "onethird", **common)


for _kind in ("forest", "bagged", "boosted"):
    pooled(_kind)(lambda rows, trees=20, _kind=_kind: learner(_kind, trees).fit(rows))


def _by_refit(obs: DataFrame, h: int, m: int, kind: str, options: dict, refit: int, rows_at: Callable, work: DataFrame | None) -> DataFrame:
    """Forecasts of the last ``m`` dates; every ``refit`` of them a new fit of ``rows_at(origin, window)`` on labels known at its first origin.

    ``rows_at`` gives rows ``panel_id, series, ds, target_ds, y, x``.  With ``work(panel_id, target, h)`` only
    its targets are forecast.
    """
    spark = obs.sparkSession
    days = [r.ds for r in obs.select("ds").distinct().orderBy(F.desc("ds")).limit(m + h).collect()][::-1]  # m + h dates
    if work is not None:
        work = work.where(F.col("h") == h).select("panel_id", F.col("target").alias("series")).distinct()
        if work.isEmpty():
            return spark.createDataFrame([], FORECAST)
    out = None
    for at in range(0, len(days) - h, refit):
        origin, part = days[at], days[at + h : at + h + refit]
        whole = rows_at(origin, at + 1)
        known = whole.where((F.col("target_ds") <= F.lit(origin)) & F.col("y").isNotNull())
        if known.isEmpty():
            continue
        tested = whole.where(F.col("target_ds").between(F.lit(part[0]), F.lit(part[-1])) & F.col("y").isNotNull())
        if work is not None:
            tested = tested.join(work, ["panel_id", "series"], "left_semi")
        pred = POOLED[kind](known.select("x", "y"), **options).transform(tested)
        one = pred.select(
            "panel_id", F.lit(kind).alias("model"), F.col("series").alias("target"), F.lit(h).alias("h"), F.col("ds").alias("origin_ds"), "target_ds",
            F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"), (F.col("y") - F.col("prediction")).alias("err"),
        )
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], FORECAST) if out is None else out


def tree_forecast(obs: DataFrame, h: int, m: int, kind: str = "forest", trees: int = 20, refit: int = 12, lags: int = 4, r: int = 0, work: DataFrame | None = None) -> DataFrame:
    return pooled_forecast(obs, h, m, kind, refit, lags, r, work, trees=trees)


def pooled_forecast(obs: DataFrame, h: int, m: int, kind: str, refit: int = 12, lags: int = 4, r: int = 0, work: DataFrame | None = None, **options) -> DataFrame:
    """Forecasts of the last ``m`` dates by a model of ``POOLED`` from pooled features and, with ``r``, that many factors of the panel.

    Features are a table that all refits read.  Scaling and loadings of the factors come from rows up to the first origin of each refit.
    """
    rows = cut(pooled_features(obs, h, lags), "pooled")

    def rows_at(origin, window: int) -> DataFrame:
        now = rows
        if r:
            wide = factors_at(obs, origin, r).groupBy("panel_id", "ds").pivot("factor", list(range(1, r + 1))).agg(F.first("value"))
            now = rows.join(wide.select("panel_id", "ds", *[F.col(str(k)).alias(f"factor{k}") for k in range(1, r + 1)]), ["panel_id", "ds"])
        names = feature_names(now)
        return VectorAssembler(inputCols=names, outputCol="x", handleInvalid="skip").transform(now.dropna(subset=names))

    return _by_refit(rows.select(*KEYS, "ds"), h, m, kind, options, refit, rows_at, work)


def permutation_importance(rows: DataFrame, trees: int = 20, kind: str = "forest", names: list[str] | None = None, share: float = 0.7, parts: int = 16) -> DataFrame:
    """``feature, importance``: rise of the held-out mean squared error when one feature's values trade places.

    The model learns from labels known by the date at ``share`` of the rows and is scored on later rows.
    Values trade places in a hashed order within each of ``parts`` hashed shares of a panel: features are the
    rows of one exploded copy, places are two row numbers joined on equality.
    """
    names = names or feature_names(rows)
    good = rows.dropna(subset=[*names, "y"]).select(*KEYS, "ds", "target_ds", "y", *names)
    day = F.unix_date(F.col("ds").cast("date"))
    split = good.agg(F.percentile_approx(day, share)).first()[0]
    if split is None:
        return rows.sparkSession.createDataFrame([], "feature string, importance double")
    model = learner(kind, trees).fit(VectorAssembler(inputCols=names, outputCol="x").transform(good.where(F.unix_date(F.col("target_ds").cast("date")) <= split)))
    held = good.where(day >= split).withColumn("_part", F.pmod(F.xxhash64("series", "ds", F.lit(3)), F.lit(parts)))
    key = Window.partitionBy("panel_id", "_part").orderBy("series", "ds")
    hashed = Window.partitionBy("panel_id", "_part").orderBy(F.xxhash64("series", "ds", F.lit(5)), "series", "ds")
    a = held.withColumn("_i", F.row_number().over(key))
    b = held.withColumn("_i", F.row_number().over(hashed)).select("panel_id", "_part", "_i", *[F.col(n).alias(f"_p_{n}") for n in names])
    many = a.join(b, ["panel_id", "_part", "_i"]).withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, names))))
    many = many.select("feature", "y", *[F.when(F.col("feature") == n, F.col(f"_p_{n}")).otherwise(F.col(n)).alias(n) for n in names])
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="x").transform(many))
    mse = scored.groupBy("feature").agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("mse"))
    base = mse.where("feature = ''").select(F.col("mse").alias("base"))
    return mse.where("feature <> ''").join(F.broadcast(base)).select("feature", (F.col("mse") - F.col("base")).alias("importance"))  # one row


def best_per_group(importance: DataFrame, groups: dict[str, str]) -> DataFrame:
    """The most important feature of each group."""
    group = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[F.col("feature")]
    return importance.withColumn("var_group", group).groupBy("var_group").agg(
        F.max_by("feature", F.struct("importance", "feature")).alias("feature"), F.max("importance").alias("importance")
    )
