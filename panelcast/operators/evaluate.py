"""Forecast errors: simple models, scores, comparison, combination and tests.

Error rows are ``panel_id, model, target, h, ds, y_true, y_pred, err`` with err = y_true - y_pred.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import by_date, KEYS
from ..kernels.inference import CRITICAL

UNIT = ("panel_id", "model", "target", "h")


def random_walk(h: int) -> Column:
    return F.lag("value", h).over(by_date())


def moving_average(h: int, k: int = 3) -> Column:
    return F.avg("value").over(by_date().rowsBetween(-h - k + 1, -h))


def ar1_direct(h: int, x: str) -> Column:
    """Regression of y[t+h] on 1, y[t] over all pairs whose label is known at the origin; ``x`` names the value h rows before."""
    known = by_date().rowsBetween(Window.unboundedPreceding, -h)
    f = lambda name: F.expr(f"{name}(value, {x})").over(known)
    return F.when(f("regr_count") > 2, f("regr_intercept") + f("regr_slope") * F.col(x))


def simple_errors(obs: DataFrame, horizons: tuple[int, ...] = (1, 3), m: int = 24) -> DataFrame:
    """Errors of the last ``m`` dates of each series for ``rw``, ``ma3`` and the benchmark ``arp``.

    All models and horizons come from one sort of the series.
    """
    late = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ds"))) <= m
    seen = obs.withColumns({f"_x{h}": random_walk(h) for h in horizons})
    made = [
        F.struct(F.lit(name).alias("model"), F.lit(h).alias("h"), F.round(pred, 6).alias("y_pred"), F.round(F.col("value") - pred, 6).alias("err"))
        for h in horizons
        for name, pred in (("rw", F.col(f"_x{h}")), ("ma3", moving_average(h)), ("arp", ar1_direct(h, f"_x{h}")))
    ]
    rows = seen.select(*KEYS, "ds", "value", late.alias("late"), F.array(*made).alias("made")).where("late and value is not null")
    each = rows.select("panel_id", F.col("series").alias("target"), "ds", F.col("value").alias("y_true"), F.explode("made").alias("f"))
    return each.where("f.y_pred is not null").select("panel_id", "f.model", "target", "f.h", "ds", "y_true", "f.y_pred", "f.err")


def mse(errors: DataFrame, by: tuple[str, ...] = UNIT) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg(F.col("err") * F.col("err")).alias("mse"), F.count("err").alias("n"))


def against_benchmark(errors: DataFrame, benchmark: str = "arp") -> DataFrame:
    """Each error beside the benchmark's of the same panel, target, horizon and date."""
    on = ["panel_id", "target", "h", "ds"]
    other = errors.where(F.col("model") == benchmark).select(*on, F.col("err").alias("err_b"))
    return errors.join(other, on)


def relative_mse(errors: DataFrame, benchmark: str = "arp", by: tuple[str, ...] = UNIT) -> DataFrame:
    square = lambda c: F.avg(F.col(c) * F.col(c))
    return against_benchmark(errors, benchmark).groupBy(*by).agg(F.try_divide(square("err"), square("err_b")).alias("relative"))


def all_targets(errors: DataFrame) -> DataFrame:
    """Per panel, model and horizon: MSE of the mean error over targets, and the mean of the targets' MSEs."""
    mean = errors.groupBy("panel_id", "model", "h", "ds").agg(F.avg("err").alias("err"))
    of_mean = mean.groupBy("panel_id", "model", "h").agg(F.avg(F.col("err") * F.col("err")).alias("mse_of_mean"))
    of_each = mse(errors).groupBy("panel_id", "model", "h").agg(F.avg("mse").alias("mean_of_mse"))
    return of_mean.join(of_each, ["panel_id", "model", "h"])


def totals(errors: DataFrame) -> DataFrame:
    """MSE per panel, over panels ("all"), and over targets, in one pass of grouping sets."""
    view = errors.select("panel_id", "model", "h", "target", (F.col("err") * F.col("err")).alias("sq"))
    sets = [["panel_id", "model", "h", "target"], ["model", "h", "target"], ["panel_id", "model", "h"]]
    grouped = view.groupingSets(sets, "panel_id", "model", "h", "target").agg(F.avg("sq").alias("mse"))
    return grouped.select(F.coalesce("panel_id", F.lit("all")).alias("panel_id"), "model", "h", F.coalesce("target", F.lit("all")).alias("target"), "mse")


def scores(errors: DataFrame, by: tuple[str, ...] = UNIT, train: DataFrame | None = None) -> DataFrame:
    """Scores of each group; with in-sample errors as ``train`` also ``fit_ratio``, out-of-sample over in-sample MSE."""
    y, p, e = F.col("y_true"), F.col("y_pred"), F.col("err")
    out = {
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "medae": F.median(F.abs(e)),
        "mape": 100 * F.avg(F.try_divide(F.abs(e), F.abs(y))),
        "smape": 200 * F.avg(F.try_divide(F.abs(e), F.abs(y) + F.abs(p))),
        "abs_corr": F.abs(F.corr(y, p)),
        "slope_gap": 1 - F.regr_slope(p, y),
    }
    scored = errors.groupBy(*by).agg(*[c.alias(n) for n, c in out.items()])
    if train is None:
        return scored
    own = train.groupBy(*by).agg(F.avg(e * e).alias("_in"))
    return scored.join(own, list(by), "left").withColumn("fit_ratio", F.try_divide("mse", "_in")).drop("_in")


def accuracy(labels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Share of rows whose predicted label is the true one, from ``y_true, y_pred``; rows without a prediction are left out."""
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return labels.where("y_pred is not null").groupBy(*by).agg(hit.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def combine(errors: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Mean of the errors of several models by date, where all are there, and its MSE."""
    used = errors.where(F.col("model").isin(*models)).groupBy("panel_id", "target", "h", "ds").agg(F.avg("err").alias("err"), F.count("err").alias("n"))
    return used.where(F.col("n") == len(models)).groupBy("panel_id", "target", "h").agg(F.avg(F.col("err") * F.col("err")).alias("mse"), F.count(F.lit(1)).alias("n"))


def pivot_models(errors: DataFrame, models: tuple[str, ...], value: str = "y_pred") -> DataFrame:
    return errors.groupBy("panel_id", "target", "h", "ds", F.col("y_true").alias("truth")).pivot("model", list(models)).agg(F.first(value))


def best_models(errors: DataFrame) -> DataFrame:
    """The model with the least absolute error for each date; the first name on ties."""
    return errors.groupBy("panel_id", "target", "h", "ds").agg(
        F.min_by(F.struct("model", "err"), F.struct(F.abs("err").alias("a"), F.col("model"))).alias("b")
    ).select("panel_id", "target", "h", "ds", F.col("b.model").alias("model"), F.col("b.err").alias("err"))


def win_counts(errors: DataFrame) -> DataFrame:
    return best_models(errors).groupBy("panel_id", "h", "model").agg(F.count(F.lit(1)).alias("wins"))


def results_table(errors: DataFrame, targets: list[str], benchmark: str = "arp") -> DataFrame:
    """Relative MSE with a row a model and horizon and a column a target."""
    return relative_mse(errors, benchmark).groupBy("panel_id", "model", "h").pivot("target", targets).agg(F.first("relative"))


def errors_to_predictions(errors: DataFrame, truth: DataFrame) -> DataFrame:
    """pred = truth - err; more than one row for a model and date is an error, raised when the result is computed."""
    key = ["panel_id", "model", "target", "h", "ds"]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one error for a model and date"))).otherwise(F.first("err"))
    single = errors.groupBy(*key).agg(once.cast("double").alias("err"))
    return single.join(truth, ["panel_id", "target", "ds"]).select(*key, "truth", (F.col("truth") - F.col("err")).alias("y_pred"))


def open_work(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return work.join(done, key, "left_anti")


def to_error_rows(errors: DataFrame, calendar: DataFrame, label: str, start: int, source: str) -> DataFrame:
    """Rows of the error table: date and crisis label are attached by position, counted from the first error."""
    n = F.row_number().over(Window.partitionBy(*UNIT).orderBy("ds"))
    days = calendar.select(F.col("date").alias("cal_date"), "crisis", F.row_number().over(Window.orderBy("date")).alias("n"))  # a row for each date of one calendar
    return errors.withColumn("n", n).join(days, "n").select(
        F.lit(source).alias("filename"), F.col("model").alias("model_name"), F.lit(start).alias("start"), F.concat(F.lit("h"), F.col("h").cast("string")).alias("horizon"),
        F.col("target").alias("target_var"), F.lit(label).alias("model_label"), F.col("cal_date").alias("date"), "crisis", F.col("err").alias("values"),
    )


def _lag_sum(rows: str, value: str, place: str, bandwidth: Column) -> Column:
    """sum over j of (1 - j / bandwidth) times the sum of u[t] u[t - j], j below the bandwidth, over an array of structs in order.

    Products are taken of rows whose places are exactly j apart.
    """
    u = lambda i: F.element_at(rows, (i + 1).cast("int"))[value]
    at = lambda i: F.element_at(rows, (i + 1).cast("int"))[place]
    n = F.size(rows)
    def one(j: Column) -> Column:
        terms = F.sequence(j, n - 1)
        pair = lambda i: F.when(at(i) - at(i - j) == j, u(i) * u(i - j)).otherwise(0.0)
        return (1 - j / bandwidth) * F.aggregate(terms, F.lit(0.0), lambda a, i: a + F.coalesce(pair(i), F.lit(0.0)))
    lags = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(bandwidth).cast("int"))), lambda j: (j < bandwidth) & (j < n))
    return F.aggregate(lags, F.lit(0.0), lambda a, j: a + one(j))


def dm_test(errors: DataFrame, benchmark: str = "arp", hac_scale: bool = False) -> DataFrame:
    """Diebold-Mariano: mean loss difference, its Newey-West error with Bartlett weights, t, p, and the small-sample t.

    Bandwidth floor(4 (m / 100)^(2/9)) + 1.  ``hac_scale`` multiplies the variance by m / (m - 1).
    """
    d = against_benchmark(errors, benchmark).where(F.col("model") != benchmark).withColumn("d", F.col("err") ** 2 - F.col("err_b") ** 2)
    rows = F.array_sort(F.collect_list(F.struct("ds", "d")))  # a unit's dates
    g = d.groupBy(*UNIT).agg(F.avg("d").alias("dm"), F.count(F.lit(1)).alias("m"), rows.alias("v"))
    g = g.withColumn("b", F.floor(4 * F.pow(F.col("m") / 100, F.lit(2 / 9))) + 1)
    g = g.withColumn("u", F.transform("v", lambda x, i: F.struct(i.alias("i"), (x["d"] - F.col("dm")).alias("u"))))
    s0 = F.aggregate("u", F.lit(0.0), lambda a, x: a + x["u"] * x["u"])
    m, h = F.col("m"), F.col("h")
    var = (s0 + 2 * _lag_sum("u", "u", "i", F.col("b").cast("double"))) / m * (m / (m - 1) if hac_scale else F.lit(1.0))
    out = g.withColumn("se", F.sqrt(var / m)).withColumn("t", F.try_divide(F.col("dm"), F.col("se")))
    small = F.sqrt((m + 1 - 2 * h + h * (h - 1) / m) / m)
    return out.select(*UNIT, "m", "dm", "se", "t", (F.col("t") * small).alias("t_small"), (2 * (1 - normal_cdf(F.abs("t")))).alias("p"), (2 * (1 - normal_cdf(F.abs(F.col("t") * small)))).alias("p_small"))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function for x >= 0 by a rational approximation of the error function (error below 1.5e-7)."""
    # fixed values: Abramowitz and Stegun (1964), formula 7.1.26
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = x / math.sqrt(2)
    t = 1 / (1 + p * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return 0.5 * (1 + 1 - poly * F.exp(-z * z))


def phillips_perron(obs: DataFrame) -> DataFrame:
    """Z_t statistic with a constant: regression of y on its lag, long-run variance by Bartlett weights over neighbouring rows."""
    seen = obs.withColumn("i", F.row_number().over(by_date())).withColumn("x", F.lag("value", 1).over(by_date())).where("x is not null and value is not null")
    rows = F.array_sort(F.collect_list(F.struct("i", "value", "x")))
    fit = seen.groupBy(*KEYS).agg(
        F.regr_slope("value", "x").alias("rho"), F.regr_intercept("value", "x").alias("a"), F.regr_sxx("value", "x").alias("sxx"), F.count(F.lit(1)).alias("n"), rows.alias("v")
    )
    fit = fit.withColumn("l", F.floor(4 * F.pow(F.col("n") / 100, F.lit(0.25))))
    fit = fit.withColumn("u", F.transform("v", lambda r, i: F.struct(i.alias("i"), (r["value"] - F.col("a") - F.col("rho") * r["x"]).alias("u"))))
    s0 = F.aggregate("u", F.lit(0.0), lambda a, r: a + r["u"] * r["u"])
    n = F.col("n")
    s = fit.withColumn("s0", s0).withColumn("lam", (F.col("s0") + 2 * _lag_sum("u", "u", "i", (F.col("l") + 1).cast("double"))) / n)
    s = s.withColumns({"g0": F.col("s0") / n, "s2": F.col("s0") / (n - 2)})
    t = (F.col("rho") - 1) / F.sqrt(F.col("s2") / F.col("sxx"))
    z = F.sqrt(F.col("g0") / F.col("lam")) * t - (F.col("lam") - F.col("g0")) / (2 * F.sqrt("lam")) * n * F.sqrt(F.col("s2") / F.col("sxx")) / F.sqrt("s2")
    return s.select(*KEYS, "n", z.alias("z_t"), critical_value(n).alias("critical"))


def critical_value(n: Column) -> Column:
    """5 % critical value with a constant."""
    c = CRITICAL
    return c[0] + c[1] / n + c[2] / n**2 + c[3] / n**3


def bootstrap_block(b: Column, t: Column, n, w: int, kind: str, seed: int = 7) -> tuple[Column, Column]:
    """Whether a block begins at place t of draw b, and the row it begins with; random numbers are integer hashes of (b, t)."""
    u = lambda k: F.pmod((b * 7919 + t * 104729 + seed + k) * 1103515245 + 12345, F.lit(2147483647))
    mixed = lambda k: F.pmod(u(k) * 48271, F.lit(2147483647))
    begins = (t % w == 0) if kind == "block" else (t == 0) | (mixed(1) % w == 0)
    return begins, mixed(2) % n


def bootstrap_index(spark, t: int, b: int, w: int, kind: str = "block", seed: int = 7) -> DataFrame:
    """``b, t, i``: row i of the sample stands at place t of draw b."""
    grid = spark.range(b * t).select(F.floor(F.col("id") / t).cast("long").alias("b"), (F.col("id") % t).cast("long").alias("t"))
    begins, start = bootstrap_block(F.col("b"), F.col("t"), t, w, kind, seed)
    starts = grid.withColumn("start", F.when(begins, start)).withColumn("from", F.when(begins, F.col("t")))
    order = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s, f = F.last("start", ignorenulls=True).over(order), F.last("from", ignorenulls=True).over(order)
    return starts.select(*[c.cast("int").alias(n) for n, c in (("b", F.col("b")), ("t", F.col("t")), ("i", F.pmod(s + F.col("t") - f, F.lit(t))))])


def bootstrap_mean(values: Column, b: Column, w: int, kind: str = "block", seed: int = 7) -> Column:
    """Mean of draw ``b`` (long) of an array of doubles, by the index of ``bootstrap_index`` for its length."""
    n = F.size(values).cast("long")
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("from"), F.lit(0.0).alias("sum"))

    def step(s: Column, t: Column) -> Column:
        begins, first = bootstrap_block(b, t, n, w, kind, seed)
        start, place = F.when(begins, first).otherwise(s["start"]), F.when(begins, t).otherwise(s["from"])
        at = F.pmod(start + t - place, n)
        return F.struct(start.alias("start"), place.alias("from"), (s["sum"] + F.get(values, at.cast("int"))).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), none, step)["sum"] / n


def selection_counts(selection: DataFrame, group: str) -> DataFrame:
    return selection.groupBy("window_id", group).agg(F.count(F.lit(1)).alias("n"))


def resample_quarter(counts: DataFrame, group: str) -> DataFrame:
    return counts.groupBy(F.date_trunc("quarter", "window_id").cast("date").alias("quarter"), group).agg(F.sum("n").alias("n"))


def minmax_normalise(df: DataFrame, column: str, by: str) -> DataFrame:
    w = Window.partitionBy(by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn("scaled", F.try_divide(F.col(column) - lo, hi - lo))


def min_selected(selection: DataFrame, windows: DataFrame, fewer: int = 2) -> DataFrame:
    """Targets whose least number of selected series over ``windows(target, window_id)`` is below ``fewer``; a window without any has 0."""
    per = selection.groupBy("target", "window_id").agg(F.count(F.lit(1)).alias("n"))
    every = windows.select("target", "window_id").distinct().join(per, ["target", "window_id"], "left")
    return every.groupBy("target").agg(F.min(F.coalesce("n", F.lit(0))).alias("least")).where(F.col("least") < fewer)


def argmin_ic(table: DataFrame, by: list[str], order: str, ic: str) -> DataFrame:
    """The order with the least criterion; the first on ties."""
    return table.groupBy(*by).agg(F.min_by(order, F.struct(ic, order)).alias(order))
