"""Factor operators.

Loadings and eigenvalues need the products X'X of a panel's standardised series only.  These are summed
on Spark from rows by date, so a panel may have any number of dates; what meets in one task is the N x N
numbers of a panel.  Factors are projections: a join and a sum.  Operators that go through a panel's dates
in order (fill, Kalman) hold one panel in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import factors as K
from ..kernels.linear import scale
from ..sources.io import cut
from .calendar import densify_panel
from .spread import dealt

LOADINGS = "panel_id string, series string, factor int, loading double"
FACTORS = "panel_id string, ds date, factor int, value double"


def per_panel(obs: DataFrame, schema: str, each: Callable, gaps: bool = False) -> DataFrame:
    """``each(matrix, dates, names)`` gives rows; series with gaps are left out unless ``gaps``."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="ds", columns="series", values="value").sort_index()
        wide = wide if gaps else wide.loc[:, wide.notna().all()]
        rows = [(pdf["panel_id"].iat[0], *r) for r in each(wide.to_numpy(float), list(wide.index), list(wide.columns))] if wide.shape[1] else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(obs, "panel_id").groupBy("panel_id").applyInPandas(task, schema)


def standard(obs: DataFrame) -> DataFrame:
    """Standardised rows of the series that have a value at every date of their panel; a constant series becomes zeros."""
    own = Window.partitionBy("panel_id", "series")
    sd = F.stddev_samp("value").over(own)
    seen = obs.select("panel_id", "series", "ds", "value", F.avg("value").over(own).alias("mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd"), F.count("value").over(own).alias("_n"))
    dates = obs.groupBy("panel_id").agg(F.count_distinct("ds").alias("_t"))
    return seen.join(dates, "panel_id").where("_n = _t").select("panel_id", "series", "ds", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def scaling(obs: DataFrame) -> DataFrame:
    """``mean, sd`` by series; a constant series has deviation 1, so it becomes zeros."""
    sd = F.stddev_samp("value")
    return obs.groupBy("panel_id", "series").agg(F.avg("value").alias("mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd"))


def scaled(obs: DataFrame, by: DataFrame) -> DataFrame:
    return obs.join(by, ["panel_id", "series"]).select("panel_id", "series", "ds", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def products(z: DataFrame, most_numbers: int = 1 << 24) -> DataFrame:
    """``panel_id, t, names, row, sums``: the rows of X'X of each panel, from partial sums by task.

    A task holds the sums of the panels it meets, and hands them on before they exceed ``most_numbers``.
    """
    by_date = z.groupBy("panel_id", "ds").agg(F.array_sort(F.collect_list(F.struct("series", "value"))).alias("v"))
    rows = by_date.select("panel_id", F.col("v.series").alias("names"), F.col("v.value").alias("x"))
    kind = pa.schema([("panel_id", pa.string()), ("names", pa.list_(pa.string())), ("row", pa.int32()), ("t", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            met: dict = {}
            for panel, names, x in zip(*(c.to_pylist() for c in batch.columns)):
                met.setdefault(panel, (names, []))[1].append(x)
            for panel, (names, x) in met.items():
                if panel not in held:
                    if sum(len(n) ** 2 for n, _, _ in held.values()) + len(names) ** 2 > most_numbers:
                        yield from out(held)
                        held = {}
                    held[panel] = [names, np.zeros((len(names), len(names))), 0]
                v = np.array(x)
                held[panel][1] += v.T @ v
                held[panel][2] += len(v)
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for panel, (names, sums, t) in held.items():
            yield pa.RecordBatch.from_pylist([{"panel_id": panel, "names": names, "row": i, "t": t, "sums": r.tolist()} for i, r in enumerate(sums)], kind)

    parts = rows.mapInArrow(each, "panel_id string, names array<string>, row int, t long, sums array<double>")
    cells = parts.select("panel_id", "names", "row", "t", F.posexplode("sums").alias("col", "s")).groupBy("panel_id", "row", "col").agg(F.first("names").alias("names"), F.sum("t").alias("t"), F.sum("s").alias("s"))
    listed = cells.groupBy("panel_id", "row").agg(F.first("names").alias("names"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("col", "s"))).alias("c"))
    return listed.select("panel_id", "names", "row", "t", F.col("c.s").alias("sums"))


def from_products(rows: DataFrame, schema: str, each: Callable) -> DataFrame:
    """``each(X'X, t, names)`` gives rows for each panel."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        made = [(pdf["panel_id"].iat[0], *r) for r in each(np.vstack(pdf["sums"].to_list()), int(pdf["t"].iat[0]), list(pdf["names"].iat[0]))]
        return pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(rows, "panel_id").groupBy("panel_id").applyInPandas(task, schema)


def _loadings(z: DataFrame, r: int) -> DataFrame:
    each = lambda gram, t, names: [(n, k + 1, float(v)) for n, row in zip(names, K.gram_loadings(gram, r)[0]) for k, v in enumerate(row)]
    return from_products(products(z), LOADINGS, each)


def loadings(obs: DataFrame, r: int) -> DataFrame:
    return _loadings(standard(obs), r)


def factors(obs: DataFrame, r: int) -> DataFrame:
    z = standard(obs)
    return project(z, _loadings(z, r)).select("panel_id", "ds", F.col("factor").cast("int").alias("factor"), "value")


def factors_at(obs: DataFrame, origin, r: int) -> DataFrame:
    """Factors at all dates with scaling and loadings from rows up to ``origin``."""
    known = obs.where(F.col("ds") <= F.lit(origin))
    return project(scaled(obs, scaling(known)), loadings(known, r))


def project(standardised: DataFrame, loading: DataFrame) -> DataFrame:
    """Factors of new rows with stored loadings: X L / N as a join and a sum."""
    n = loading.select("panel_id", "series").distinct().groupBy("panel_id").agg(F.count(F.lit(1)).alias("n"))
    return standardised.join(loading, ["panel_id", "series"]).join(n, "panel_id").groupBy("panel_id", "ds", "factor").agg((F.sum(F.col("value") * F.col("loading")) / F.first("n")).alias("value"))


def factor_counts(obs: DataFrame, most: int = 8) -> DataFrame:
    def each(gram, t, names):
        n, eigen = len(names), K.gram_loadings(gram, 1)[1]
        if n < 2:  # no number to choose
            return
        for rule, k in K.factor_count_ic(eigen, t, n, min(most, n - 1)).items():
            yield rule, k
        yield "gap", K.factor_count_gap(eigen / t, min(most, n - 6))

    return from_products(products(standard(obs)), "panel_id string, rule string, n_factors int", each)


FILLED = "panel_id string, series string, ds date, filled double"


def factor_fill(obs: DataFrame, r: int = 2, most: int = 50, tol: float = 1e-6, most_cells: int = 1 << 20) -> DataFrame:
    """``panel_id, series, ds, filled``: gaps from the fit of ``r`` factors, refitted until fits stand still (relative change of squares below ``tol``) or ``most`` times.

    Panels of up to ``most_cells`` cells are iterated in a task each; larger ones take part in rounds, in which no task holds
    a panel: by rows of series where these are more than the dates (``fill_by_series``), else by dates (``fill_by_rounds``).
    All give the same numbers.  A date or series that a row names is filled throughout its panel.
    """
    obs = cut(obs.select("panel_id", "series", "ds", "value"), "fill-obs")
    sizes = obs.groupBy("panel_id").agg(F.count_distinct("series").alias("n"), F.count_distinct("ds").alias("t"))
    sizes = cut(sizes.where(F.col("n") * F.col("t") > most_cells).select("panel_id", (F.col("n") > F.col("t")).alias("wide")), "fill-sizes")  # a row a large panel
    kinds = {row.wide for row in sizes.select("wide").distinct().collect()}

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="ds", columns="series", values="value").sort_index()
        filled = K.factor_fill(wide.to_numpy(float), r, most, tol)
        names, days = wide.columns.to_numpy(object), wide.index.to_numpy(object)
        return pd.DataFrame({"panel_id": pdf["panel_id"].iat[0], "series": np.tile(names, len(days)), "ds": np.repeat(days, len(names)), "filled": filled.ravel()})

    small = obs.join(sizes, "panel_id", "left_anti") if kinds else obs
    out = dealt(small, "panel_id").groupBy("panel_id").applyInPandas(task, FILLED)
    for wide in kinds:
        each = densify_panel(obs.join(sizes.where(F.col("wide") == wide), "panel_id", "left_semi"))
        out = out.unionByName((fill_by_series if wide else fill_by_rounds)(each, r, most, tol))
    return out


def fill_by_series(obs: DataFrame, r: int = 2, most: int = 50, tol: float = 1e-6) -> DataFrame:
    """``fill_by_rounds`` for panels of more series than dates: a row holds a series, and T x T numbers of a panel meet in a task.

    A round sums the products of dates over the standardised series, takes their first ``r`` eigenvectors, and projects
    each series on these.  Every series must have a row at every date of its panel.
    """
    keys = ["panel_id", "series"]
    lists = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ds", "value"))).alias("v"))
    first = lists.select(*keys, F.col("v.value").alias("value"), F.lit(None).cast("array<double>").alias("fit"))
    active = cut(dealt(first, *keys), "fill-series")
    days = cut(obs.select("panel_id", "ds").distinct().groupBy("panel_id").agg(F.array_sort(F.collect_list("ds")).alias("days")), "fill-days")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Panel, rows, values, fits before (None in the first round), values with gaps filled, their means and deviations; a row a series."""
        for pdf in batches:
            for panel, rows in pdf.groupby("panel_id", sort=False):
                x = np.vstack([np.asarray(v, float) for v in rows["value"]])
                known = ~np.isnan(x)
                if rows["fit"].iat[0] is None:
                    fit, other = None, (np.where(known, x, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1))[:, None]
                else:
                    fit = other = np.vstack(rows["fit"].to_list())
                full = np.where(known, x, other)
                mean, sd = scale(full.T)
                yield panel, rows, x, fit, full, mean[:, None], sd[:, None]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for panel, _, _, _, full, mean, sd in matrices(batches):
            z = (full - mean) / sd
            if panel not in held and sum(g.size for g in held.values()) + z.shape[1] ** 2 > 1 << 24:
                yield from (parts(p, g) for p, g in held.items())
                held = {}
            held[panel] = held.get(panel, 0.0) + z.T @ z
        yield from (parts(p, g) for p, g in held.items())

    def parts(panel: str, gram: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"panel_id": panel, "row": np.arange(len(gram)), "sums": list(gram)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"panel_id": pdf["panel_id"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [np.sum(pdf["sums"].to_list(), axis=0)]})

    def basis(pdf: pd.DataFrame) -> pd.DataFrame:
        u = K.gram_basis(np.vstack(pdf.sort_values("row")["sums"].to_list()), r)
        return pd.DataFrame({"panel_id": pdf["panel_id"].iloc[:1], "basis": [u.ravel()]})

    def project_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows, x, before, full, mean, sd in matrices(batches):
            u = np.asarray(rows["basis"].iat[0]).reshape(x.shape[1], -1)
            fit = ((full - mean) / sd) @ u @ u.T * sd + mean
            moved = (None, None) if before is None else (((fit - before) ** 2).sum(axis=1), (before**2).sum(axis=1))
            yield pd.DataFrame({"panel_id": rows["panel_id"], "series": rows["series"], "value": rows["value"], "fit": list(fit), "moved": moved[0], "size": moved[1], "gaps": np.isnan(x).any(axis=1)})

    out = None
    for turn in range(most):
        rows = active.mapInPandas(sums, "panel_id string, row int, sums array<double>")
        gram = rows.groupBy("panel_id", "row").applyInPandas(total, "panel_id string, row int, sums array<double>")
        bases = cut(gram.groupBy("panel_id").applyInPandas(basis, "panel_id string, basis array<double>"), "fill-basis")
        made = active.join(bases, "panel_id").mapInPandas(project_rows, "panel_id string, series string, value array<double>, fit array<double>, moved double, size double, gaps boolean")
        fitted = cut(made, "fill-series")
        moved = F.sum("moved") / F.greatest(F.sum("size"), F.lit(1e-300))
        ended = F.coalesce(moved < tol, F.lit(False)) | ~F.bool_or("gaps") | F.lit(turn == most - 1)
        state = cut(fitted.groupBy("panel_id").agg(ended.alias("ended")), "fill-state")  # a row a panel
        known = {row.ended for row in state.select("ended").distinct().collect()}
        if True in known:
            done = fitted.join(state.where("ended"), "panel_id", "left_semi").select(*keys, F.arrays_zip("value", "fit").alias("v")).join(days, "panel_id")
            cells = done.select(*keys, F.posexplode("v").alias("i", "v"), "days")
            cells = cells.select(*keys, F.expr("days[i]").alias("ds"), F.coalesce(F.nanvl("v.value", F.lit(None).cast("double")), "v.fit").alias("filled"))
            out = cells if out is None else out.unionByName(cells)
        if False not in known:
            break
        active = fitted.join(state.where("not ended"), "panel_id", "left_semi").select(*keys, "value", "fit")
    return out


def fill_by_rounds(obs: DataFrame, r: int = 2, most: int = 50, tol: float = 1e-6) -> DataFrame:
    """``factor_fill`` as rounds over all panels at once; each round is a table, and panels leave once their fits stand still.

    A round sums X'X of the standardised rows by date, takes loadings from it (N x N numbers of a panel in a task), and
    projects: fits are a join and a sum.  What the driver sees is whether any panel is left.
    """
    keys = ["panel_id", "series"]
    mean = F.coalesce(F.avg("value").over(Window.partitionBy(*keys)), F.lit(0.0))
    active = cut(obs.select(*keys, "ds", "value", F.coalesce("value", mean).alias("filled"), F.lit(None).cast("double").alias("fit")), "fill")
    out, again = None, True
    for turn in range(most):
        by = scaling(active.select(*keys, "ds", F.col("filled").alias("value")))
        z = scaled(active.select(*keys, "ds", F.col("filled").alias("value")), by)
        load = cut(_loadings(z, r), "fill-loadings")  # for the factors and the fit
        factor = project(z, load).withColumnRenamed("value", "f")
        part = factor.join(load, ["panel_id", "factor"]).groupBy(*keys, "ds").agg(F.sum(F.col("f") * F.col("loading")).alias("part"))
        fitted = active.join(part, [*keys, "ds"]).join(by, keys)
        now = F.col("part") * F.col("sd") + F.col("mean")
        rows = cut(fitted.select(*keys, "ds", "value", F.coalesce("value", now).alias("filled"), now.alias("fit"), F.col("fit").alias("before")), "fill")
        moved = rows.groupBy("panel_id").agg((F.sum((F.col("fit") - F.col("before")) ** 2) / F.greatest(F.sum(F.col("before") ** 2), F.lit(1e-300))).alias("moved"), (F.count("value") == F.count(F.lit(1))).alias("whole"))
        ended = F.col("whole") | (F.coalesce(F.col("moved"), F.lit(float("inf"))) < tol) | F.lit(turn == most - 1)
        state = cut(moved.select("panel_id", ended.alias("ended")), "fill-state")  # a row a panel
        done = rows.join(state.where("ended"), "panel_id", "left_semi").select(*keys, "ds", F.coalesce("value", "filled").alias("filled"))
        out = done if out is None else out.unionByName(done)
        again = not state.where("not ended").isEmpty()
        if not again:
            break
        active = rows.join(state.where("not ended"), "panel_id", "left_semi").drop("before")
    return out


def factor_r2(standardised: DataFrame, loading: DataFrame, factor: DataFrame) -> DataFrame:
    """By series and factor k: ``r2`` with the first k factors, ``marginal`` = the gain of the k-th; and the panel's means of them.

    ``factor_share`` is the mean over series of the k-th factor's gain, ``total_share`` that of all up to it.
    """
    parts = loading.join(factor.withColumnRenamed("value", "f"), ["panel_id", "factor"]).withColumn("part", F.col("loading") * F.col("f"))
    w = Window.partitionBy("panel_id", "series", "ds").orderBy("factor")
    fit = parts.withColumn("fit", F.sum("part").over(w)).join(standardised, ["panel_id", "series", "ds"])
    r2 = fit.groupBy("panel_id", "series", "factor").agg((1 - F.var_samp(F.col("value") - F.col("fit")) / F.var_samp("value")).alias("r2"))
    before = F.lag("r2", 1, 0.0).over(Window.partitionBy("panel_id", "series").orderBy("factor"))
    each = r2.withColumn("marginal", F.col("r2") - before)
    shares = each.groupBy("panel_id", "factor").agg(F.avg("marginal").alias("factor_share"), F.avg("r2").alias("total_share"))
    return each.join(shares, ["panel_id", "factor"]).select("panel_id", "series", "factor", "r2", "marginal", "factor_share", "total_share")


def top_series(r2: DataFrame, k: int = 10, places: int | None = None) -> DataFrame:
    """The ``k`` series with the greatest gain of each factor, by name where gains are equal (to ``places`` decimals, if given)."""
    by = F.col("marginal") if places is None else F.round("marginal", places)
    n = F.row_number().over(Window.partitionBy("panel_id", "factor").orderBy(by.desc(), "series"))
    return r2.withColumn("place", n).where(F.col("place") <= k)


def _on_factors(factor: DataFrame, schema: str, each: Callable) -> DataFrame:
    """``each(T x r matrix)`` gives rows for each panel; only r numbers a date meet in a task."""
    return per_panel(factor.select("panel_id", "ds", F.col("factor").alias("series"), "value"), schema, lambda x, days, names: each(x))


def var_orders(obs: DataFrame, r: int = 2, most: int = 4) -> DataFrame:
    return _on_factors(factors(obs, r), "panel_id string, rule string, p int", lambda f: list(K.var_order(f, most).items()))


def dynamic_counts(obs: DataFrame, r: int = 4, p: int = 1) -> DataFrame:
    """``rule, n_dynamic``: by the next eigenvalue (``one``) and by all further ones (``rest``)."""
    n = standard(obs).groupBy("panel_id").agg(F.count_distinct("series").alias("n"))
    rows = factors(obs, r).join(n, "panel_id").select("panel_id", "ds", F.col("factor").cast("string").alias("series"), "value", "n")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.pivot(index="ds", columns="series", values="value").sort_index().to_numpy(float)
        made = K.dynamic_factor_count(f, p, int(pdf["n"].iat[0]))
        return pd.DataFrame([(pdf["panel_id"].iat[0], rule, k) for rule, k in zip(("one", "rest"), made)], columns=["panel_id", "rule", "n_dynamic"])

    return dealt(rows, "panel_id").groupBy("panel_id").applyInPandas(task, "panel_id string, rule string, n_dynamic int")


def two_step_factors(obs: DataFrame, r: int = 2, p: int = 1, q: int | None = None) -> DataFrame:
    """Smoothed factors of each panel from a VAR(p) of ``r`` factors with ``q`` shocks; series with gaps and ragged edges stay."""
    return per_panel(obs, FACTORS, lambda x, days, _: [(d, k + 1, float(v)) for d, row in zip(days, K.two_step(x, r, p, q)["smooth"]) for k, v in enumerate(row)], gaps=True)


def state_forecasts(obs: DataFrame, r: int = 2, h: int = 3, p: int = 1, q: int | None = None) -> DataFrame:
    """Every series ``h`` steps after the panel's last date."""
    return per_panel(obs, "panel_id string, series string, y_pred double", lambda x, d, names: list(zip(names, K.state_forecast(K.two_step(x, r, p, q), h).tolist())), gaps=True)
