"""Sources and sinks, forecast models, selection, factors and tests (groups S, M, V, C, F, T, K of the inventory)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..operators import autoregress as AR
from ..operators import evaluate as E
from ..operators import factors as FA
from ..operators import forests as FO
from ..operators import linear as L
from ..operators import stationary as ST
from ..operators import trees as TR
from ..kernels import linear as KL
from ..operators.calendar import carry_forward, densify_panel
from ..operators.features import enrich, standardise
from ..plans.grid import run_models, stored_models
from ..plans.panels import dense, gappy, growth, growth_sql, panel, sql, table
from ..sources import io
from .evaluate import CRISIS_SQL, ERR, SELECTION_SQL, errors, selection
from .registry import query, r8

KEYS = ["panel_id", "series", "ds"]
HORIZONS, M = [1, 3], 24


def brands(spark, d):
    return growth(spark, d, "brand")


def names(spark, d):
    """The brands, sorted: columns of wide tables; a dimension of its own that does not grow with the facts."""
    return sorted(r.p_brand for r in table(spark, d, "part").select("p_brand").distinct().collect())


# --- sources and sinks --------------------------------------------------------------------------
def _vintage(spark, d):
    obs = panel(spark, d, "brand")
    meta = obs.select("series").distinct().withColumn("tcode", F.substring("series", 7, 9).cast("int") % 7 + 1)
    path = io.scratch(spark, "vintage")
    io.write_vintage(obs, meta, path, names(spark, d))
    return io.read_vintage(spark, path)


@query("s01_read_vintage", sql("brand", "select series, ds, value from p"))
def s01(spark, d):
    return _vintage(spark, d)[0].where("value is not null").select("series", "ds", "value")


@query("s01_read_vintages", sql("region", "select panel_id, series, ds, value from p where substr(series, 7)::int % 5 <> substr(panel_id, 7)::int"))
def s01_many(spark, d):
    """A vintage for each region; each lacks the series of one group."""
    obs = panel(spark, d, "region").where(F.substring("series", 7, 9).cast("int") % 5 != F.substring("panel_id", 7, 9).cast("int"))
    meta = obs.select("panel_id", "series").distinct().withColumn("tcode", F.substring("series", 7, 9).cast("int") % 7 + 1)
    path = io.scratch(spark, "vintages")
    io.write_vintages(obs, meta, path)
    return io.read_vintages(spark, path, panel="panel_id=([^/]*)")[0].where("value is not null")


@query("s03_override_tcode", sql("brand", "select distinct series, case when series = 'CPIMEDSL' then 6 when substr(series, 7)::int % 7 + 1 in (4, 6) then 5 else substr(series, 7)::int % 7 + 1 end as tcode from p"))
def s03(spark, d):
    return _vintage(spark, d)[1].select("series", "tcode").withColumn("tcode", io.override_tcode(F.col("series"), F.col("tcode")))


@query("s02_clean_names", "select distinct p_type, regexp_replace('A & ' || p_type || ':B', '[ &:]', '', 'g') as clean from part")
def s02(spark, d):
    kinds = table(spark, d, "part").select("p_type").distinct()
    return kinds.withColumn("clean", io.clean_name(F.concat(F.lit("A & "), "p_type", F.lit(":B"))))


@query("s04_read_matrix", "select (row_number() over (order by p_partkey))::int as \"row\", unnest([1, 2, 3]) as col, unnest([p_partkey::double, p_size::double, p_retailprice]) as value from part")
def s04(spark, d):
    path = io.scratch(spark, "matrix")
    rows = table(spark, d, "part").orderBy("p_partkey")  # one file a range of keys, in order
    rows.select(F.concat_ws(";", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("value")).write.text(path)
    return io.read_matrix(spark, path)


@query("s05_read_recessions", "select distinct date_trunc('month', o_orderdate)::date as start, (date_trunc('month', o_orderdate) + interval 4 month)::date as \"end\" from orders")
def s05(spark, d):
    months = table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("a")).distinct()
    text = lambda c, q: F.concat(F.date_format(c, "MMMM yyyy"), F.lit(f" ({q})"))
    path = io.scratch(spark, "recessions")
    months.select(text(F.col("a"), "I").alias("start"), text(F.add_months("a", 4), "II").alias("end")).write.csv(path, sep=";", header=True)
    return io.read_recessions(spark, path)


@query("s06_read_group_map", "select distinct p_brand as series, 'group' || (substr(p_brand, 7)::int % 5) as var_group from part")
def s06(spark, d):
    path = io.scratch(spark, "groups")
    names = table(spark, d, "part").select("p_brand").distinct()
    names.select(F.lit(129).alias("ID"), F.col("p_brand").alias("VAR"), F.concat(F.lit("group"), (F.substring("p_brand", 7, 9).cast("int") % 5).cast("string")).alias("Group")).write.csv(path, sep=";", header=True)
    return io.read_group_map(spark, path)


def _error_rows(spark, d):
    from .evaluate import calendar

    return E.to_error_rows(errors(spark, d), calendar(spark, d), "simple", 192, "run")


_PLACED = ", k as (select *, row_number() over (order by date) as n from cal), n as (select *, row_number() over (partition by panel_id, model, target, h order by ds) as n from e)"


@query("s07_write_errors", sql("brand", ERR + CRISIS_SQL + _PLACED + " select model as model_name, 'h' || h as horizon, count(*) as n, sum(err::decimal(18,6))::double as total from n join k using (n) group by all"))
def s07(spark, d):
    path, rows = io.scratch(spark, "errors"), _error_rows(spark, d)
    io.write_errors(rows.where("model_name = 'rw'"), path)
    io.write_errors(rows.where("model_name <> 'rw'"), path, append=True)
    return spark.read.parquet(path).groupBy("model_name", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("values").cast("decimal(18,6)")).cast("double").alias("total"))


@query("s10_write_selection", sql("brand", SELECTION_SQL + " select window_id, base, transform, n, 'largest' as method, 1 as h, target from s"))
def s10(spark, d):
    path = io.scratch(spark, "selection")
    io.write_selection(selection(spark, d).withColumn("method", F.lit("largest")).withColumn("h", F.lit(1)), path)
    return spark.read.parquet(path)


# --- forecast models ----------------------------------------------------------------------------
def _forecast(name: str, model: str, source: str = "brand", m: int = M, **options) -> None:
    @query(name)
    def run(spark, d):
        obs = growth(spark, d, source)
        return L.forecast(obs, L.work_list(obs, None, HORIZONS, m), m, model, **options)


@query("m02_arp_direct")
def m02_direct(spark, d):
    return AR.ar_forecasts(growth(spark, d, "region"), HORIZONS, M)


@query("m02b_arp_iterated")
def m02b(spark, d):
    return AR.ar_forecasts(growth(spark, d, "region"), HORIZONS, M, iterated=True)


_forecast("m03_ar_factor", "ar_factor")
_forecast("m03_ar_factor_iterated", "ar_factor_iterated")
_forecast("m04_lasso", "lasso", "region", ic="bic")
_forecast("m04_elastic_net", "elastic_net", ic="aic")
_forecast("m05_ridge", "ridge")
_forecast("m06_adaptive_lasso", "adaptive_lasso", m=12)
_forecast("m12_state_factors", "state", "region")


@query("m04_lasso_full_size")
def m04_full(spark, d):
    """The workload's full size: 192 origins, four horizons, five targets, 200 penalties by validation in blocks of 5, on hourly rows."""
    hours = table(spark, d, "events").groupBy(F.lit("event").alias("panel_id"), F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    first = F.min("hour").over(Window.partitionBy("panel_id"))
    step = ((F.unix_timestamp("hour") - F.unix_timestamp(first)) / 3600).cast("int")
    placed = hours.withColumn("step", step)  # hours stand as days of a calendar
    grid = placed.groupBy("panel_id", "series").agg(F.sequence(F.min("step"), F.max("step")).alias("s")).select("panel_id", "series", F.explode("s").alias("step"))
    obs = grid.join(placed, ["panel_id", "series", "step"], "left").select("panel_id", "series", F.date_add(F.lit("2000-01-01").cast("date"), "step").alias("ds"), "value")
    obs = carry_forward(obs)
    return L.forecast(obs, L.work_list(obs, None, [1, 3, 6, 12], 192), 192, "lasso", ic="cv")


def one_ridge(x, y, now, info, penalty: float = 10.0):
    """Ridge on the target's own value alone."""
    j = info["names"].index(info["target"])
    mean, sd = KL.scale(x[:, [j]])
    z = (x[:, [j]] - mean) / sd
    b = KL.ridge_path(z.T @ z, z.T @ (y - y.mean()), np.array([penalty]))[0]
    value = lambda v: y.mean() + ((v[..., [j]] - mean) / sd) @ b
    return float(value(now)), float(((y - value(x)) ** 2).mean()), {info["target"]: float(b[0])}


def one_lasso(x, y, now, info, penalty: float = 0.02):
    """Lasso on the target's own value alone."""
    j = info["names"].index(info["target"])
    mean, sd = KL.scale(x[:, [j]])
    z = (x[:, [j]] - mean) / sd
    b = KL.lasso_path(z.T @ z / len(y), z.T @ (y - y.mean()) / len(y), np.array([penalty]))[0]
    value = lambda v: y.mean() + ((v[..., [j]] - mean) / sd) @ b
    return float(value(now)), float(((y - value(x)) ** 2).mean()), {info["target"]: float(b[0])}


def _one_sql(coef: str) -> str:
    """One-predictor regressions by window: pairs s = w .. t - m + w - 2 h of the origin t - m + w - h, from 0."""
    return growth_sql("flag", f""", r5 as (select panel_id, count(distinct ds) as t from g5 group by all), o5 as (select g5.panel_id, series from g5 join r5 using (panel_id) group by all having count(*) = max(t)),
i5 as (select g5.*, row_number() over w - 1 as i, lead(value) over w as y, lead(ds) over w as target_ds, count(*) over (partition by panel_id, series) as t from g5 join o5 using (panel_id, series) window w as (partition by panel_id, series order by ds)),
w5 as (select a.panel_id, a.series, k.k as w, avg(a.value) as mx, stddev_samp(a.value) as sd, avg(a.y) as my, count(*) as n, regr_sxy(a.y, a.value) as sxy from i5 a join range(0, {M}) k(k) on a.i between k.k and a.t - {M} + k.k - 2 group by all)
select w5.panel_id, w5.series as target, 1 as h, (w + 1)::int as window_id, ds as origin_ds, target_ds, round(my + (value - mx) / sd * {coef}, 8) as y_pred
from w5 join i5 on w5.panel_id = i5.panel_id and w5.series = i5.series and i5.i = i5.t - {M} + w - 1""")


def _one(spark, d, model):
    obs = growth(spark, d, "flag")
    return L.forecast(obs, L.work_list(obs, None, [1], M), M, model).select("panel_id", "target", "h", "window_id", "origin_ds", "target_ds", r8("y_pred").alias("y_pred"))


@query("m05_ridge_one", _one_sql("(sxy / sd) / (n - 1 + 10.0)"))
def m05_one(spark, d):
    return _one(spark, d, one_ridge)


@query("m04_lasso_one", _one_sql("sign(sxy) * greatest(abs(sxy / sd / n) - 0.02, 0) / ((n - 1) / n)"))
def m04_one(spark, d):
    return _one(spark, d, one_lasso)


@query("m04_lasso_importances")
def m04_importances(spark, d):
    obs = brands(spark, d)
    return L.importances(obs, L.work_list(obs, None, [1], M), M, "lasso", ic="bic")


def _trees(name: str, kind: str, horizons: list[int], r: int) -> None:
    @query(name)
    def run(spark, d):
        obs, out = brands(spark, d), None
        for h in horizons:
            rows = TR.tree_forecast(obs, h, 12, kind, 20, refit=6, r=r)
            out = rows if out is None else out.unionByName(rows)
        return out


_trees("m09_bagged_trees", "bagged", [1], 0)
_trees("m10_boosted_trees", "boosted", [1], 0)


@query("m07i_permutation_importance")
def m07i(spark, d):
    return TR.permutation_importance(TR.pooled_features(brands(spark, d), 1), 20)


_forecast("m07_random_forest", "random_forest")


@query("m07_random_forest_full_size")
def m07_full(spark, d):
    """Forests of 500 trees on the components and lags of all series, four horizons."""
    obs = growth(spark, d, "flag")
    return L.forecast(obs, L.work_list(obs, None, [1, 3, 6, 12], M), M, "random_forest", trees=500)


@query("m07_forest_importances")
def m07_importances(spark, d):
    """Out-of-bag importances of every window's forest."""
    obs = growth(spark, d, "flag")
    return L.importances(obs, L.work_list(obs, None, HORIZONS, M), M, "random_forest", importance=True)


@query("m08_preselected_forest")
def m08(spark, d):
    obs = brands(spark, d)
    return FO.preselected_forecast(obs, L.select_penalised(obs, L.work_list(obs, None, HORIZONS, M), M), M, trees=50)


@query("m13_run_models")
def m13(spark, d):
    obs = brands(spark, d)
    one = obs.select("panel_id").distinct().withColumns({"target": F.lit("Brand#1"), "h": F.lit(1)})
    every = obs.select("panel_id", F.col("series").alias("target"), F.lit(3).alias("h")).distinct()
    done = one.withColumn("model", F.lit("arp_direct")).unionByName(one.withColumn("model", F.lit("forest"))).unionByName(every.withColumn("model", F.lit("forest")))
    return run_models(obs, None, HORIZONS, ["arp_direct", "ar_factor", "forest"], 12, done, 10)


@query("m13_stored_models")
def m13_stored(spark, d):
    """The grid in a folder: a run of one model, then one of three that finds the first done."""
    obs, path = growth(spark, d, "region"), io.scratch(spark, "grid")
    stored_models(obs, None, [1], ["arp_direct"], 12, path, 2)
    return stored_models(obs, None, [1], ["arp_direct", "ridge", "ar_factor"], 12, path, 2)


def _enriched(spark, d):
    obs = brands(spark, d)
    split = obs.select("ds").distinct().orderBy(F.desc("ds")).limit(12).agg(F.min("ds")).first()[0]  # loadings know nothing of the last year
    return enrich(obs, FA.factors_at(obs, split, 2)) if split else obs


@query("m14_feature_enrich")
def m14(spark, d):
    return _enriched(spark, d)


_STATS = " select panel_id, series, ds, round(value, 8) + 0.0 as value, " + ", ".join(f"case when row_number() over w > 5 then round({f}(value) over q, 8) + 0.0 else 0.0 end as {n}_before" for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"))) + " from g5 window w as (partition by panel_id, series order by ds), q as (partition by panel_id, series order by ds rows between unbounded preceding and 1 preceding)"


@query("m14_feature_enrich_stats", growth_sql("brand", _STATS))
def m14s(spark, d):
    return _enriched(spark, d).select(*KEYS, *[r8(c).alias(c) for c in ("value", "min_before", "mean_before", "max_before")])


# --- selection and validation -------------------------------------------------------------------
@query("v01_select_penalised")
def v01(spark, d):
    obs = brands(spark, d)
    work = L.work_list(obs, None, HORIZONS, M)
    return L.select_penalised(obs, work, M, 1.0, "bic").unionByName(L.select_penalised(obs, work, M, 0.5, "aic"))


@query("v02_select_one_per_group")
def v02(spark, d):
    obs = brands(spark, d)
    return L.select_one_per_group(obs, L.work_list(obs, None, [1], M), M, brand_group)


def brand_group(name: str) -> str:
    return str(int(name[6:]) % 5)


@query("v03_select_one_per_group_rf")
def v03(spark, d):
    obs = brands(spark, d)
    return FO.select_one_per_group(obs, L.work_list(obs, None, [1], M), M, brand_group, trees=20)


@query("k02_most_important_per_group")
def k02(spark, d):
    rows = TR.pooled_features(brands(spark, d), 1)
    return TR.best_per_group(TR.permutation_importance(rows, 10), {n: "lag" if "lag" in n else "level" for n in TR.feature_names(rows)})


@query("v04_select_recursive_rf")
def v04(spark, d):
    obs = brands(spark, d)
    return FO.select_recursive(obs, L.work_list(obs, None, [1], M), M, brand_group, trees=20)


@query("c02_block_cv_lambda")
def c02(spark, d):
    obs = brands(spark, d)
    return L.lambda_choice(obs, L.work_list(obs, None, [1], M), M, 1.0, "cv")


@query("c03_adaptive_grid")
def c03(spark, d):
    obs = brands(spark, d)
    return L.lambda_choice(obs, L.work_list(obs, None, [1], M), M, 1.0, "grid")


@query("c05_hyperparameter_search")
def c05(spark, d):
    tries = L.random_candidates(24)
    return L.hyperparameter_search(carry_forward(dense(spark, d, "region")), None, 1, tries + tries[:3])


SEARCHED = [
    *({"model": "lasso", "ic": ic} for ic in ("bic", "aic")),
    *({"model": "ridge", "lam": lam} for lam in (1.0, 30.0, 1000.0)),
    *({"model": "arp_direct", "most": most} for most in (1, 6)),
    {"model": "random_forest", "trees": 20, "lags": 2},
]


@query("c05_search_models")
def c05_models(spark, d):
    """One search over penalised, autoregressive and tree models, in two runs over one ledger."""
    obs, ledger = brands(spark, d), io.scratch(spark, "ledger")
    L.search_models(obs, None, HORIZONS, SEARCHED[:3], ledger=ledger)
    return L.search_models(obs, None, HORIZONS, SEARCHED, ledger=ledger)


# --- factors ------------------------------------------------------------------------------------
def regions(spark, d):
    return growth(spark, d, "region")


@query("f01_loadings")
def f01(spark, d):
    return FA.loadings(regions(spark, d), 3)


@query("f01_factors")
def f01f(spark, d):
    return FA.factors(regions(spark, d), 3)


@query("f01_project")
def f01p(spark, d):
    obs = regions(spark, d)
    return FA.project(standardise(obs), FA.loadings(obs, 3))


def _embedding_panels(spark, d):
    """A panel a label, a row a vector, a series a component."""
    rows = table(spark, d, "embeddings").select("vec_id", F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"), F.posexplode("embedding").alias("k", "v"))
    return rows.select(F.concat(F.lit("label"), "label").alias("panel_id"), F.format_string("e%02d", "k").alias("series"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("ds"), F.col("v").cast("double").alias("value"))


@query("f02_factor_count")
def f02(spark, d):
    return FA.factor_counts(_embedding_panels(spark, d)).unionByName(FA.factor_counts(regions(spark, d)))


@query("f03_factor_count_gap")
def f03(spark, d):
    return FA.factor_counts(_embedding_panels(spark, d)).where("rule = 'gap'")


@query("f04_factor_fill")
def f04(spark, d):
    return FA.factor_fill(dense(spark, d, "nation"), 2)


@query("f04_fill_by_rounds")
def f04_rounds(spark, d):
    """All panels at once in rounds of joins and sums, as large ones are filled, until fits move by less than a ten-thousandth."""
    return FA.fill_by_rounds(densify_panel(dense(spark, d, "region")), 2, tol=1e-4)


def _r2(spark, d):
    obs = regions(spark, d)
    return FA.factor_r2(standardise(obs), FA.loadings(obs, 3), FA.factors(obs, 3))


@query("f05_factor_r2")
def f05(spark, d):
    return _r2(spark, d)


@query("k01_top_series")
def k01(spark, d):
    return FA.top_series(_r2(spark, d), 10)


def _given_loadings(spark, d):
    """Standardised rows and given loadings: all one for factor 1, -1 to 1 by the name's number for factor 2."""
    obs = standardise(growth(spark, d, "region"))
    places = obs.select("panel_id", "series").distinct()
    second = (F.substring("series", 7, 9).cast("int") % 5 - 2).cast("double") / 2
    load = places.select("panel_id", "series", F.explode(F.array(F.struct(F.lit(1).alias("factor"), F.lit(1.0).alias("loading")), F.struct(F.lit(2).alias("factor"), second.alias("loading")))).alias("l")).select("panel_id", "series", "l.factor", "l.loading")
    return obs, load


def _given(spark, d):
    """Shares of explained variance for given loadings."""
    obs, load = _given_loadings(spark, d)
    return FA.factor_r2(obs, load, FA.project(obs, load))


_R2 = growth_sql("region", """, z5 as materialized (select panel_id, series, ds, (value - avg(value) over a) / stddev_samp(value) over a as value from g5 window a as (partition by panel_id, series)),
l2 as (select distinct panel_id, series, f.f as factor, case f.f when 1 then 1.0 else (substr(series, 7)::int % 5 - 2) / 2.0 end::double as loading from z5, (values (1), (2)) f(f)),
n2 as (select panel_id, count(distinct series) as n from l2 group by all),
f2 as (select z5.panel_id, z5.ds, l2.factor, sum(z5.value * l2.loading) / any_value(n) as f from z5 join l2 using (panel_id, series) join n2 using (panel_id) group by all),
t2 as (select z5.panel_id, z5.series, z5.ds, l2.factor, z5.value, sum(l2.loading * f2.f) over (partition by z5.panel_id, z5.series, z5.ds order by l2.factor) as fit from z5 join l2 using (panel_id, series) join f2 on f2.panel_id = z5.panel_id and f2.ds = z5.ds and f2.factor = l2.factor),
r2 as (select panel_id, series, factor, 1 - var_samp(value - fit) / var_samp(value) as r2 from t2 group by all),
m2 as (select *, r2 - coalesce(lag(r2) over (partition by panel_id, series order by factor), 0) as marginal from r2),
a2 as (select *, avg(marginal) over p as factor_share, avg(r2) over p as total_share from m2 window p as (partition by panel_id, factor)) """)
_R2_COLUMNS = ("r2", "marginal", "factor_share", "total_share")


@query("f01_project_given", _R2 + "select panel_id, ds, factor, round(f, 6) + 0.0 as value from f2")
def f01_given(spark, d):
    obs, load = _given_loadings(spark, d)
    return FA.project(obs, load).select("panel_id", "ds", "factor", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("f05_factor_r2_given", _R2 + "select panel_id, series, factor, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in _R2_COLUMNS) + " from a2")
def f05_given(spark, d):
    return _given(spark, d).select("panel_id", "series", "factor", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _R2_COLUMNS])


@query("k01_top_series_given", _R2 + ", k2 as (select *, row_number() over (partition by panel_id, factor order by round(marginal, 8) desc, series) as place from a2) select panel_id, series, factor, round(marginal, 6) + 0.0 as marginal, place from k2 where place <= 10")
def k01_given(spark, d):
    return FA.top_series(_given(spark, d), 10, places=8).select("panel_id", "series", "factor", (F.round("marginal", 6) + F.lit(0.0)).alias("marginal"), "place")


@query("f06_var_order")
def f06(spark, d):
    return FA.var_orders(regions(spark, d))


@query("f07_dynamic_factor_count")
def f07(spark, d):
    return FA.dynamic_counts(regions(spark, d))


@query("f08_two_step_factors")
def f08(spark, d):
    """Two factors, two lags, one shock, on series with gaps."""
    return FA.two_step_factors(gappy(spark, d, "region"), 2, 2, 1)


@query("m12_state_forecast")
def m12(spark, d):
    return FA.state_forecasts(gappy(spark, d, "region"), 2, 3, 2, 1)


# --- tests --------------------------------------------------------------------------------------
@query("t01_adf")
def t01(spark, d):
    return ST.adf(dense(spark, d, "supp"))


_ADF = """, y1 as (select panel_id, series, value - avg(value) over (partition by panel_id, series) as y, row_number() over (partition by panel_id, series order by ds) as i from d where value is not null),
x1 as (select *, lag(y) over w as x, y - lag(y) over w as v from y1 window w as (partition by panel_id, series order by i)),
z1 as (select *, lag(v) over (partition by panel_id, series order by i) as z from x1),
m1 as (select panel_id, series, count(*) as n, regr_sxx(v, x) as xx, regr_sxx(v, z) as zz, regr_sxy(z, x) as xz, regr_sxy(v, x) as xv, regr_sxy(v, z) as zv, regr_syy(v, z) as vv from z1 where i >= 3 group by all having count(*) > 4),
b1 as (select *, (xv * zz - zv * xz) / (xx * zz - xz * xz) as b, (zv * xx - xv * xz) / (xx * zz - xz * xz) as c from m1)
select panel_id, series, round(b / sqrt((vv - b * xv - c * zv) / (n - 3) * zz / (xx * zz - xz * xz)), 6) as t, n::int as n from b1"""


@query("t01_adf_one_lag", sql("supp", _ADF))
def t01_one(spark, d):
    return ST.adf(dense(spark, d, "supp"), fixed=1).where("n > 4").select("panel_id", "series", F.round("t", 6).alias("t"), "n")


@query("t03_keep_stationary")
def t03(spark, d):
    kept, dropped = ST.keep_stationary(dense(spark, d, "brand"))
    return kept.select("panel_id", "series").distinct().withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query("t06_model_confidence_set")
def t06(spark, d):
    return ST.confidence_set(errors(spark, d))
