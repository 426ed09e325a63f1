"""Stationarity transforms of a series, by number or by name.

All work on ``obs(panel_id, series, ds, value)`` on a regular calendar (see
``operators.calendar.densify``), with one window over (panel_id, series) by ds.
Missing is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("panel_id", "series")
SMALL = 1e-6
NAMES = {
    1: "lvl", 2: "dif_1m", 3: "2nd_dif_1m", 4: "log", 5: "dif_log", 6: "2nd_dif_log", 7: "dif_pct",
    8: "pct_1y", 9: "dif_1y", 10: "pct_1q", 11: "dif_1q", 12: "box",
}


def by_date() -> WindowSpec:
    """The rows of a series in order."""
    return Window.partitionBy(*KEYS).orderBy("ds")


def whole() -> WindowSpec:
    """All rows of a series."""
    return Window.partitionBy(*KEYS)


def lag(c: Column, k: int) -> Column:
    return F.lag(c, k).over(by_date())


def transform(code: int, x: Column | None = None) -> Column:
    """The transform with this code; 12 needs ``box_cox``."""
    x = F.col("value") if x is None else x
    least = F.min(x).over(whole())
    log = F.when(least > SMALL, F.ln(x))
    if code == 1:
        return x
    if code == 2:
        return x - lag(x, 1)
    if code == 3:
        return x - 2 * lag(x, 1) + lag(x, 2)
    if code == 4:
        return F.when(least >= SMALL, F.ln(x))
    if code == 5:
        return log - lag(log, 1)
    if code == 6:
        return log - 2 * lag(log, 1) + lag(log, 2)
    if code == 7:
        return F.try_divide(x - lag(x, 1), lag(x, 1)) - F.try_divide(lag(x, 1) - lag(x, 2), lag(x, 2))
    if code in (8, 10):
        back = lag(x, 12 if code == 8 else 3)
        return F.try_divide(100 * (x - back), F.abs(back))
    if code in (9, 11):
        return x - lag(x, 12 if code == 9 else 3)
    raise ValueError(f"no transform {code}")


def box_cox(obs: DataFrame, grid: tuple[float, ...] = tuple(i / 10 for i in range(-20, 21))) -> DataFrame:
    """Box-Cox with the most likely lambda of a grid for each series; NULL unless its least value is above 1e-6.

    The log-likelihood is -n/2 ln(population variance of the transformed) + (lambda - 1) sum of ln x.
    """
    good = obs.where("value is not null").withColumn("least", F.min("value").over(whole())).where(F.col("least") > SMALL)
    many = good.withColumn("lam", F.explode(F.array(*map(F.lit, grid))))
    y = _box(F.col("value"), F.col("lam"))
    fit = many.groupBy(*KEYS, "lam").agg(
        (-F.count(F.lit(1)) / 2 * F.ln(F.var_pop(y)) + (F.col("lam") - 1) * F.sum(F.ln("value"))).alias("ll")
    )
    best = fit.where("ll is not null").groupBy(*KEYS).agg(F.max_by("lam", F.struct("ll", "lam")).alias("lam"))
    return obs.join(best, list(KEYS), "left").withColumn("box", _box(F.col("value"), F.col("lam")))


def _box(x: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-9, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)


def detrended(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: from the 13th row after leading gaps, ``column`` less the mean of the 12 values before.

    NULL there unless all 12 are present; earlier rows keep their value.
    """
    x = F.col(column)
    before = by_date().rowsBetween(-12, -1)
    seen = df.withColumn("_n", F.row_number().over(by_date())).withColumn("_first", F.min(F.when(x.isNotNull(), F.col("_n"))).over(whole()))
    full = F.when(F.count(x).over(before) == 12, x - F.avg(x).over(before))
    return seen.withColumn(out, F.when(F.col("_n") - F.col("_first") < 12, x).otherwise(full)).drop("_n", "_first")


def apply_tcode(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """One transform for each series, by ``meta(panel_id, series, tcode)`` with codes 1 to 7."""
    chosen = F.coalesce(*[F.when(F.col("tcode") == c, transform(c)) for c in range(1, 8)])
    coded = obs.join(meta.select(*KEYS, "tcode"), list(KEYS))
    name = F.element_at(F.create_map(*[F.lit(v) for c in range(1, 8) for v in (c, NAMES[c])]), F.col("tcode"))
    return coded.select(*KEYS, "ds", name.alias("transform"), chosen.alias("value"))


def apply_all(obs: DataFrame, codes: tuple[int, ...] = tuple(range(1, 8)), detrend: bool = False) -> DataFrame:
    """Every transform of every series in long form, ``transform`` beside ``series``; one sort serves them all."""
    wide = box_cox(obs).drop("lam") if 12 in codes else obs
    for c in codes:
        wide = wide if c == 12 else wide.withColumn(NAMES[c], transform(c))
    outs = [NAMES[c] for c in codes]
    if detrend:
        for o in list(outs):
            wide = detrended(wide, o, f"{o}_detrended")
            outs.append(f"{o}_detrended")
    return wide.unpivot([*KEYS, "ds"], outs, "transform", "value")


def joined_name(base: Column, kind: Column) -> Column:
    """Base name and transform as one output name."""
    return F.concat_ws("_", base, kind)
