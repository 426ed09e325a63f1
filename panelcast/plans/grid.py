"""The grid of targets, horizons and models, minus what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forests, linear as L  # noqa: F401  forests registers its models
from ..operators.evaluate import open_work
from ..operators.trees import POOLED, pooled_forecast
from ..sources.io import scratch, table_exists

KEY = ["panel_id", "target", "h"]
COLUMNS = ["panel_id", "model", "target", "h", "origin_ds", "target_ds", "y_true", "y_pred", "err"]


def run_models(obs: DataFrame, targets: list[str] | None, horizons: list[int], models: list[str | Callable], m: int, done: DataFrame | None = None, trees: int = 20, refit: int = 12) -> DataFrame:
    """Forecast rows of every open (panel, target, horizon, model); ``done`` has the keys already stored.

    A model is a name of ``linear.MODELS`` or ``trees.POOLED``, or a function of the first one's protocol.  A pooled model
    whose targets are all done at a horizon isn't fitted there; ``trees`` is for those that grow trees.
    """
    out = None
    for model in models:
        work = L.work_list(obs, targets, horizons, m)
        if done is not None:
            work = open_work(work, done.where(F.col("model") == label(model)), KEY)
        if model in POOLED:
            for h in horizons:
                rows = pooled_forecast(obs, h, m, model, refit, work=work.select(*KEY).distinct(), **_options(POOLED[model], trees))
                out = rows if out is None else out.unionByName(rows)
            continue
        rows = L.forecast(obs, work, m, model).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def _options(fit: Callable, trees: int) -> dict:
    return {"trees": trees} if "trees" in fit.__code__.co_varnames[: fit.__code__.co_argcount] else {}


def label(model: str | Callable) -> str:
    return model if isinstance(model, str) else model.__name__


def finished(spark: SparkSession, path: str) -> set[tuple[str, int, int]]:
    """The units of the manifest: (model, horizon, slice)."""
    if not table_exists(spark, f"{path}/done"):
        return set()
    return {tuple(r) for r in spark.read.parquet(f"{path}/done").select("model", "h", "slice").collect()}  # a row a unit


def stored_models(obs: DataFrame, targets: list[str] | None, horizons: list[int], models: list[str | Callable], m: int, path: str, slices: int = 4, trees: int = 20, refit: int = 12) -> DataFrame:
    """``run_models`` into the folder ``path``, continuing where an earlier run stopped; all stored forecasts.

    A unit of work is a model, a horizon and a slice of the panels (by hash).  Its rows are written to a folder of their own
    and then the manifest gets its line, so a run that ends between the two leaves rows nobody reads, and the next run
    overwrites them: no unit counts twice, none that is in the manifest is run again, and at most one is lost.
    The folder belongs to one panel table, ``targets``, ``m`` and number of slices.  A run that has units to do makes the panel
    table once, and a unit reads its own slice of it, whatever the number of units.
    """
    spark = obs.sparkSession
    units = [(model, h, s) for model in models for h in horizons for s in range(slices)]
    done = finished(spark, path)
    todo = [(model, h, s) for model, h, s in units if (label(model), h, s) not in done]
    parts = _sliced(obs, slices) if todo else obs
    for model, h, s in todo:
        rows = run_models(parts.where(F.col("grid_slice") == s).drop("grid_slice"), targets, [h], [model], m, None, trees, refit)
        rows.drop("model", "h").write.mode("overwrite").parquet(_unit(path, label(model), h, s))
        spark.createDataFrame([(label(model), h, s)], "model string, h int, slice int").coalesce(1).write.mode("append").parquet(f"{path}/done")
    folders = [_unit(path, label(model), h, s) for model, h, s in units]
    return spark.read.option("basePath", f"{path}/forecasts").parquet(*folders).select(*[F.col(c).cast("int") if c == "h" else F.col(c) for c in COLUMNS])


def _sliced(obs: DataFrame, slices: int) -> DataFrame:
    """The panel table in the shared folder, a subfolder a slice."""
    spark, path = obs.sparkSession, scratch(obs.sparkSession, "slices")
    rows = obs.withColumn("grid_slice", F.pmod(F.xxhash64("panel_id"), F.lit(slices)).cast("int"))
    rows.write.partitionBy("grid_slice").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _unit(path: str, model: str, h: int, s: int) -> str:
    return f"{path}/forecasts/model={model}/h={h}/slice={s}"
