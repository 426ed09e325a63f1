"""Regular calendars, samples and edges of panels."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import by_date, KEYS, whole

STEPS = {"month": "interval 1 month", "hour": "interval 1 hour", "day": "interval 1 day"}


def densify(obs: DataFrame, freq: str = "month") -> DataFrame:
    """Every date from a series' first to its last; dates without a row get a NULL value."""
    span = obs.groupBy(*KEYS).agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    grid = span.select(*KEYS, F.explode(F.expr(f"sequence(a, b, {STEPS[freq]})")).alias("ds"))
    return grid.join(obs, [*KEYS, "ds"], "left")


def clip_sample(obs: DataFrame, start: str, end: str) -> DataFrame:
    return obs.where(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_all_missing(obs: DataFrame) -> DataFrame:
    some = obs.groupBy(*KEYS).agg(F.count("value").alias("n")).where("n > 0")
    return obs.join(some, list(KEYS), "left_semi")


def drop_incomplete(obs: DataFrame) -> DataFrame:
    full = obs.groupBy(*KEYS).agg((F.count("value") == F.count(F.lit(1))).alias("full")).where("full")
    return obs.join(full, list(KEYS), "left_semi")


def drop_sparse_head(obs: DataFrame, m: int, ratio: float = 0.9, limit: float = 0.8) -> DataFrame:
    """Drops series with more than ``limit`` NULLs in the first ceil((T - m) ratio^2 / 100) 100 rows, at most T."""
    head = F.least(F.ceil((F.col("t") - m) * (ratio * ratio) / 100) * 100, F.col("t"))
    seen = obs.withColumn("n", F.row_number().over(by_date())).withColumn("t", F.count(F.lit(1)).over(whole()))
    share = seen.where(F.col("n") <= head).groupBy(*KEYS).agg(F.avg(F.col("value").isNull().cast("int")).alias("share"))
    return obs.join(share.where(F.col("share") > limit), list(KEYS), "left_anti")


def trim_bad_edges(obs: DataFrame, limit: float = 0.8, all_missing: bool = False) -> DataFrame:
    """Deletes leading and trailing dates of a panel where more than ``limit`` of the series (or all) are NULL."""
    share = F.avg(F.col("value").isNull().cast("int"))
    bad = share >= 1 if all_missing else share > limit
    good = (
        obs.groupBy("panel_id", "ds").agg(bad.alias("bad")).where("not bad").groupBy("panel_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    )
    return obs.join(good, "panel_id").where("ds between a and b").drop("a", "b")


def last_rows(obs: DataFrame, m: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ds")))
    return obs.withColumn("_n", n).where(F.col("_n") <= m).drop("_n")


def oos_period(obs: DataFrame, m: int) -> DataFrame:
    """First and last label of the last ``m`` dates of each panel."""
    n = F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("ds")))
    dates = obs.select("panel_id", "ds").distinct().withColumn("n", n).where(F.col("n") <= m)
    return dates.groupBy("panel_id").agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


def densify_panel(obs: DataFrame) -> DataFrame:
    """Every series of a panel at every date of the panel; what is missing is NULL."""
    grid = obs.select("panel_id", "series").distinct().join(obs.select("panel_id", "ds").distinct(), "panel_id")
    return grid.join(obs, [*KEYS, "ds"], "left").select(*KEYS, "ds", "value")


def drop_first(obs: DataFrame, k: int) -> DataFrame:
    return obs.withColumn("_n", F.row_number().over(by_date())).where(F.col("_n") > k).drop("_n")


def decimal_to_date(d: Column) -> Column:
    """YEAR + MONTH/12 as the first of the month; a whole number is December of the year before."""
    k = F.round(d * 12).cast("int") - 1
    return F.make_date(F.floor(k / 12).cast("int"), F.pmod(k, F.lit(12)) + 1, F.lit(1))


def date_to_decimal(d: Column) -> Column:
    """Year and the share of it that has gone."""
    days = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.year(d) + (F.dayofyear(d) - 1) / days


def crisis_months(recessions: DataFrame, pre: int = 0, post: int = 0) -> DataFrame:
    """Distinct months of ``recessions(start, end)``, each widened by ``pre`` and ``post`` months."""
    months = F.expr(f"sequence(add_months(trunc(start, 'MM'), -{pre}), add_months(trunc(end, 'MM'), {post}), interval 1 month)")
    return recessions.select(F.explode(months).alias("ds")).distinct()


def crisis_flag(dates: DataFrame, crisis: DataFrame) -> DataFrame:
    marked = crisis.select("ds", F.lit(1).alias("crisis"))
    return dates.join(marked, "ds", "left").withColumn("crisis", F.coalesce("crisis", F.lit(0)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Each point with every interval of its keys that holds it, both ends included: ``start`` and ``end`` are timestamps, exact to the microsecond.

    Intervals are dealt into bins of ``width`` seconds and meet the points of a bin by equality; a point is in one bin, so no
    pair occurs twice.  The width should be near the length of most intervals: a longer one is copied to each bin it
    touches.  Intervals that end before they start, and nulls, hold nothing.
    """
    place = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width * 1e6))
    bins = intervals.where("start <= end").withColumn("_bin", F.explode(F.sequence(place("start"), place("end"))))
    pairs = points.withColumn("_bin", place(at)).join(bins, [*keys, "_bin"])
    return pairs.where(F.col(at).between(F.col("start"), F.col("end"))).drop("_bin")


def interval_flag(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """``points`` with ``n_intervals`` that hold them, and ``crisis`` 1 where there is one; points are told apart by keys and time."""
    on = [*keys, at]
    held = interval_join(points.select(*on).distinct(), intervals.select(*keys, "start", "end"), keys, at, width)
    n = held.groupBy(*on).agg(F.count(F.lit(1)).alias("n_intervals"))
    out = points.join(n, on, "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))
    return out.withColumn("crisis", (F.col("n_intervals") > 0).cast("int"))


def split_sample(rows: DataFrame, crisis: DataFrame, part: str) -> DataFrame:
    if part == "full":
        return rows
    return rows.join(crisis.select("ds"), "ds", "left_semi" if part == "crisis" else "left_anti")


def horizon_pairs(obs: DataFrame, h: int) -> DataFrame:
    """``x`` at ds with ``y``, the value h steps later; no self-join."""
    y = F.lead("value", h).over(by_date())
    return obs.select(*KEYS, "ds", F.col("value").alias("x"), y.alias("y"), F.lead("ds", h).over(by_date()).alias("target_ds")).where("target_ds is not null")


def rolling_windows(obs: DataFrame, m: int, h: int) -> DataFrame:
    """Row x window membership: window w = 1..m holds rows w to T - m + w - h.

    For looking at windows; estimators use prefix sums instead of this fan-out.
    """
    seen = obs.withColumn("s", F.row_number().over(by_date())).withColumn("t", F.count(F.lit(1)).over(whole()))
    first = F.greatest(F.lit(1), F.col("s") - (F.col("t") - m - h))
    last = F.least(F.lit(m), F.col("s"))
    return seen.where((F.col("t") > m + h) & (first <= last)).select(*KEYS, "ds", "s", F.explode(F.sequence(first, last)).alias("window_id"), "value")


def time_series_split(obs: DataFrame, k: int = 5) -> DataFrame:
    """Expanding splits: split i tests rows n - (k - i + 1) (n div (k + 1)) and the size after, trains on all before."""
    seen = obs.withColumn("s", F.row_number().over(by_date())).withColumn("n", F.count(F.lit(1)).over(whole()))
    size = F.floor(F.col("n") / (k + 1))
    many = seen.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("size", size)
    start = F.col("n") - (k - F.col("split") + 1) * F.col("size")
    part = F.when(F.col("s") <= start, "train").when(F.col("s") <= start + F.col("size"), "test")
    return many.withColumn("part", part).where("part is not null").select(*KEYS, "ds", "split", "part")


def block_splits(lengths: DataFrame, h: int, ratio: float = 0.7, test: int = 5) -> DataFrame:
    """Rolling blocks of ``lengths(panel_id, series, t)``: train floor(ratio t) rows, then a gap of h, then ``test`` rows; the last takes the rest.

    Rows are those of the predictors; labels are h rows later, so the first test row is h after the last training label's origin.
    """
    train = F.floor(F.col("t") * ratio).cast("int")
    blocks = F.floor((F.col("t") - F.col("train") - 2 * h) / test).cast("int")
    many = lengths.withColumn("train", train).withColumn("blocks", blocks).where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    a = (F.col("block") - 1) * test + 1
    test_a = a + F.col("train") + h
    return many.select(
        *KEYS, "block", a.alias("train_from"), (a + F.col("train") - 1).alias("train_to"), test_a.alias("test_from"),
        F.when(F.col("block") == F.col("blocks"), F.col("t") - h).otherwise(test_a + test - 1).alias("test_to"),
    )


def matlab_percentile(obs: DataFrame, **wanted: float) -> DataFrame:
    """Percentiles of each series, ``name=p``, at position n p / 100 + 0.5 with linear steps between neighbours; one sort for all."""
    order = Window.partitionBy(*KEYS).orderBy("value")
    seen = obs.where("value is not null").withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole()))
    n, out = F.col("n"), []
    for name, p in wanted.items():
        at = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * p / 100 + 0.5))
        value = lambda place: F.max(F.when(F.col("i") == place, F.col("value")))
        out.append((value(F.floor(at)) + (value(F.ceil(at)) - value(F.floor(at))) * F.max(at - F.floor(at))).alias(name))
    return seen.groupBy(*KEYS).agg(*out)


def flag_outliers(obs: DataFrame, k: float = 10.0, method: str = "matlab") -> DataFrame:
    """``is_outlier`` where a value is more than k interquartile ranges from the median; ``cleaned`` is NULL there."""
    if method == "matlab":
        stats = matlab_percentile(obs, q1=25.0, med=50.0, q3=75.0)
    else:
        q = lambda p: F.percentile("value", F.lit(p))
        stats = obs.groupBy(*KEYS).agg(q(0.25).alias("q1"), q(0.5).alias("med"), q(0.75).alias("q3"))
    out = F.coalesce(F.abs(F.col("value") - F.col("med")) > k * (F.col("q3") - F.col("q1")), F.lit(False))
    return obs.join(stats, list(KEYS), "left").select(*obs.columns, out.alias("is_outlier"), F.when(~out, F.col("value")).alias("cleaned"))


def ma_fill(obs: DataFrame, k: int = 3) -> DataFrame:
    """At missing rows: the median of the series put there, then the centred mean of 2k + 1 terms, edges repeated."""
    frame = by_date().rowsBetween(-k, k)
    med = F.percentile("value", F.lit(0.5)).over(whole())
    seen = obs.withColumn("_f", F.coalesce("value", med)).withColumn("_n", F.row_number().over(by_date())).withColumn("_t", F.count(F.lit(1)).over(whole()))
    first, last = F.first("_f").over(by_date().rowsBetween(Window.unboundedPreceding, 0)), F.last("_f").over(by_date().rowsBetween(0, Window.unboundedFollowing))
    pad = F.greatest(F.lit(0), k + 1 - F.col("_n")) * first + F.greatest(F.lit(0), k - (F.col("_t") - F.col("_n"))) * last
    mean = (F.sum("_f").over(frame) + pad) / (2 * k + 1)
    return seen.select(*obs.columns, F.coalesce("value", mean).alias("filled"))


def carry_forward(obs: DataFrame) -> DataFrame:
    """Gaps take the last value before them, so a fill never sees later rows."""
    so_far = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return obs.withColumn("value", F.last("value", ignorenulls=True).over(so_far))
