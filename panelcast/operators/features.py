"""Features of series for forecasting: lags, scaling, expanding statistics, smoothing, fills."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.transforms import by_date, KEYS, whole
from ..kernels.spline import spline_fill_many
from .calendar import ma_fill, trim_bad_edges
from .spread import dealt, each_batch, each_series


def before() -> WindowSpec:
    """Strictly earlier rows."""
    return by_date().rowsBetween(Window.unboundedPreceding, -1)


def up_to() -> WindowSpec:
    """Rows up to this one."""
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def lag_features(df: DataFrame, k: int, column: str = "value") -> DataFrame:
    return df.withColumns({f"{column}_lag{i}": F.lag(column, i).over(by_date()) for i in range(1, k + 1)})


def standardise(obs: DataFrame, column: str = "value") -> DataFrame:
    x = F.col(column)
    return obs.withColumn(column, F.try_divide(x - F.avg(x).over(whole()), F.stddev_samp(x).over(whole())))


def window_scaling(obs: DataFrame, m: int, h: int) -> DataFrame:
    """``panel_id, series, window_id, origin_ds, n, mean, sd, z``: statistics of each rolling window and its last value by them.

    Window w = 1..m has rows w to T - m + w - h.  Sums are differences of two prefixes, so rows aren't copied to the windows
    they belong to; values are taken less the first known one against cancellation.  ``sd`` is the sample deviation; ``z`` is
    NULL where it is 0 or unknown.
    """
    near = F.first("value", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = F.col("value") - F.col("_near")
    seen = obs.select(*KEYS, "ds", "value", near.alias("_near"), F.row_number().over(by_date()).alias("_s"), F.count(F.lit(1)).over(whole()).alias("_t"))
    sums = seen.select(*KEYS, "ds", "value", "_near", "_s", (F.col("_t") - m - h + 1).alias("_size"), F.count("value").over(up_to()).alias("_n"), F.sum(c).over(up_to()).alias("_a"), F.sum(c * c).over(up_to()).alias("_b"))
    ends = sums.where((F.col("_size") > 0) & F.col("_s").between(F.col("_size"), F.col("_size") + m - 1)).withColumn("_from", F.col("_s") - F.col("_size"))
    starts = sums.select(*KEYS, F.col("_s").alias("_from"), F.col("_n").alias("_n0"), F.col("_a").alias("_a0"), F.col("_b").alias("_b0"))
    both = ends.join(starts, [*KEYS, "_from"], "left")
    less = lambda c: F.col(c) - F.coalesce(F.col(f"{c}0"), F.lit(0))
    both = both.select(*KEYS, (F.col("_from") + 1).cast("int").alias("window_id"), F.col("ds").alias("origin_ds"), "value", "_near", less("_n").alias("n"), less("_a").alias("a"), less("_b").alias("b"))
    mean, spread = F.try_divide("a", "n"), F.greatest(F.lit(0.0), F.col("b") - F.try_divide(F.col("a") * F.col("a"), F.col("n")))
    sd = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1)))
    out = both.withColumns({"mean": F.col("_near") + mean, "sd": sd})
    z = F.when(F.col("sd") > 1e-12, (F.col("value") - F.col("mean")) / F.col("sd"))
    return out.select(*KEYS, "window_id", "origin_ds", "n", "mean", "sd", z.alias("z"))


def demean(mode: int, x: Column | None = None) -> Column:
    """0 as is, 1 less the mean, 2 standardised, 3 less the expanding mean, over the full-sample deviation."""
    x = F.col("value") if x is None else x
    spread = F.stddev_samp(x).over(whole())
    if mode == 0:
        return x
    centred = x - (F.avg(x).over(up_to()) if mode == 3 else F.avg(x).over(whole()))
    return centred if mode == 1 else F.try_divide(centred, spread)


def expanding_stats(obs: DataFrame, first: int = 5) -> DataFrame:
    """Least, mean and greatest value of strictly earlier rows; 0 in the first rows."""
    late = F.row_number().over(by_date()) > first
    stats = {"min": F.min("value"), "mean": F.avg("value"), "max": F.max("value")}
    return obs.withColumns({f"{k}_before": F.when(late, f.over(before())).otherwise(0.0) for k, f in stats.items()})


def ema(obs: DataFrame, alpha: float = 0.2) -> DataFrame:
    """e = alpha x + (1 - alpha) e before it, from the first value, without bias adjustment; one pass over each series."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(ema=pdf["value"].ewm(alpha=alpha, adjust=False).mean())

    rows = obs.select(*KEYS, "ds", "value")
    out = each_series(rows, each, f"panel_id string, series string, ds {rows.schema['ds'].dataType.simpleString()}, value double, ema double")
    blank = F.lit(None).cast("double")
    return out.withColumns({c: F.nanvl(c, blank) for c in ("value", "ema")})


def fft_amplitudes(obs: DataFrame, terms: int = 5) -> DataFrame:
    """Amplitudes of the first Fourier terms of each strictly earlier prefix, long form; only these terms are computed."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x, days = pdf["value"].to_numpy(float), pdf["ds"].to_numpy()
        n, k = len(x), np.arange(terms)
        amp = np.full((max(n - 1, 0), terms), np.nan)
        for size in range(1, n):
            wave = np.exp(-2j * np.pi / size * (np.outer(k[: min(terms, size)], np.arange(size)) % size))
            amp[size - 1, : len(wave)] = np.abs(wave @ x[:size])
        out = pd.DataFrame({"ds": np.repeat(days[1:], terms), "term": np.tile(k, max(n - 1, 0)), "amplitude": amp.ravel()})
        short = np.tile(k, max(n - 1, 0)) >= np.repeat(np.arange(1, n), terms)
        return out[~short].assign(panel_id=pdf["panel_id"].iat[0], series=pdf["series"].iat[0])[["panel_id", "series", "ds", "term", "amplitude"]]

    return each_series(obs.select(*KEYS, "ds", "value"), each, "panel_id string, series string, ds date, term long, amplitude double")


def seasonal_decompose(obs: DataFrame, period: int) -> DataFrame:
    """Trailing trend, expanding seasonal mean by phase and residual, as known one row before."""
    frame = by_date().rowsBetween(1 - period, 0)
    trend = F.when(F.count("value").over(frame) == period, F.avg("value").over(frame))
    seen = obs.withColumn("_phase", F.row_number().over(by_date()) % period).withColumn("_trend", trend)
    phase = Window.partitionBy(*KEYS, "_phase").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_seasonal", F.avg(F.col("value") - F.col("_trend")).over(phase))
    parts = {"trend": F.col("_trend"), "seasonal": F.col("_seasonal"), "residual": F.col("value") - F.col("_trend") - F.col("_seasonal")}
    return seen.select(*obs.columns, *[F.lag(c, 1).over(by_date()).alias(n) for n, c in parts.items()])


def spline_fill(obs: DataFrame) -> DataFrame:
    """Cubic not-a-knot spline through the known values, between the first and the last of them."""

    def each(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        filled = spline_fill_many(pc.cast(rows["value"], pa.float64()).to_numpy(), starts)
        return rows.drop_columns("value").append_column("filled", pa.array(filled, from_pandas=True))

    return each_batch(obs.select(*KEYS, "ds", "value"), each, "panel_id string, series string, ds date, filled double")


def fill_gaps(obs: DataFrame, mode: int, k: int = 3) -> DataFrame:
    """``filled`` by one of five ways: 1 moving average at all gaps; 2 dates that lack most series at the edges are cut, then spline, then moving
    average at what is left; 3 dates without any value at the edges are cut, nothing is filled; 4 as 2 with the cut of 3; 5 as 2 without a cut.
    Rows are dealt over a given number of tasks before windows: they are few bytes and much memory once sorted.
    """
    if mode == 1:
        return ma_fill(dealt(obs, *KEYS), k).select(*KEYS, "ds", "filled")
    rows = trim_bad_edges(obs, all_missing=mode != 2) if mode in (2, 3, 4) else obs
    if mode == 3:
        return rows.select(*KEYS, "ds", F.col("value").alias("filled"))
    return ma_fill(dealt(spline_fill(rows).withColumnRenamed("filled", "value"), *KEYS), k).select(*KEYS, "ds", "filled")


def enrich(obs: DataFrame, factor: DataFrame, r: int = 2, terms: int = 5, period: int = 31) -> DataFrame:
    """Values with statistics, Fourier amplitudes and seasonal parts of earlier rows, the exponential average and the panel's factors."""
    wide = factor.groupBy("panel_id", "ds").pivot("factor", list(range(1, r + 1))).agg(F.first("value"))
    wide = wide.select("panel_id", "ds", *[F.col(str(k)).alias(f"factor{k}") for k in range(1, r + 1)])
    waves = fft_amplitudes(obs, terms).groupBy(*KEYS, "ds").pivot("term", list(range(terms))).agg(F.first("amplitude"))
    waves = waves.select(*KEYS, "ds", *[F.col(str(k)).alias(f"fft{k}") for k in range(terms)])
    on = [*KEYS, "ds"]
    out = expanding_stats(obs.select(*on, "value")).join(ema(obs).drop("value"), on).join(seasonal_decompose(obs.select(*on, "value"), period).drop("value"), on)
    return out.join(waves, on, "left").join(wide, ["panel_id", "ds"])


def trend_forecast(obs: DataFrame, z: float = 1.2815515655446004) -> DataFrame:
    """One step ahead from a linear trend over strictly earlier rows, with a band of ``z`` standard errors."""
    seen = obs.withColumn("_t", F.row_number().over(by_date()).cast("double"))
    f = lambda e: F.expr(e).over(before())
    n, mt, sxx, syy, sxy = f("count(value)"), f("avg(_t)"), f("regr_sxx(value, _t)"), f("regr_syy(value, _t)"), f("regr_sxy(value, _t)")
    seen = seen.withColumns({"_n": n, "_mt": mt, "_sxx": sxx, "_s2": F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / (n - 2), "yhat": f("regr_intercept(value, _t)") + f("regr_slope(value, _t)") * F.col("_t")})
    half = z * F.sqrt("_s2") * F.sqrt(1 + 1 / F.col("_n") + (F.col("_t") - F.col("_mt")) ** 2 / F.col("_sxx"))
    late = seen.where("_n > 2")
    return late.select(*obs.columns, "yhat", (F.col("yhat") - half).alias("lower"), (F.col("yhat") + half).alias("upper"))
