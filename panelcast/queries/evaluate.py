"""Forecast errors and their evaluation (groups S8-S9, A, J, W24-W26, K, U1, T, M1-M2 of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import evaluate as E
from ..operators import linear as L
from ..plans.panels import RECESSIONS_SQL, dense, panel, recessions, sql
from .registry import query, r8

UNIT = ["panel_id", "model", "target", "h"]
M = 24


def errors(spark, d, name="brand"):
    return E.simple_errors(dense(spark, d, name), (1, 3), M)


def _errors_sql(source: str = "d", m: int = M, name: str = "e") -> str:
    one = []
    for h in (1, 3):
        x = f"(select *, lag(value, {h}) over (partition by panel_id, series order by ds) as x from {source})"
        known = f"(partition by panel_id, series order by ds rows between unbounded preceding and {h} preceding)"
        preds = {
            "rw": "x",
            "ma3": f"avg(value) over (partition by panel_id, series order by ds rows between {h + 2} preceding and {h} preceding)",
            "arp": f"case when regr_count(value, x) over {known} > 2 then regr_intercept(value, x) over {known} + regr_slope(value, x) over {known} * x end",
        }
        one += [
            f"select panel_id, '{n}' as model, series as target, {h} as h, ds, value as y_true, {p} as pred, row_number() over (partition by panel_id, series order by ds desc) as n from {x}"
            for n, p in preds.items()
        ]
    return f", {name} as materialized (select panel_id, model, target, h, ds, y_true, round(pred, 6) as y_pred, round(y_true - pred, 6) as err from (" + " union all ".join(one) + f") where n <= {m} and y_true is not null and pred is not null)"


ERR = _errors_sql()
SQ = "avg(err * err)"


def q(name, body, panel_name="brand"):
    return query(name, sql(panel_name, ERR + " " + body))


@query("m01_rw", sql("supp", ERR + " select panel_id, target, h, ds, y_true, y_pred, err from e where model = 'rw'"))
def m01(spark, d):
    return errors(spark, d, "supp").where("model = 'rw'").drop("model")


@query("m02_ar1", sql("supp", ERR + " select panel_id, target, h, ds, y_pred from e where model = 'arp'"))
def m02(spark, d):
    return errors(spark, d, "supp").where("model = 'arp'").select("panel_id", "target", "h", "ds", "y_pred")


@q("a01_mse", f"select panel_id, model, target, h, round({SQ}, 6) as mse, count(err) as n from e group by all")
def a01(spark, d):
    return E.mse(errors(spark, d)).withColumn("mse", F.round("mse", 6))


@q("a02_relative_mse", f"select e.panel_id, e.model, e.target, e.h, round(avg(e.err * e.err) / avg(b.err * b.err), 8) as relative from e join e b using (panel_id, target, h, ds) where b.model = 'arp' group by all")
def a02(spark, d):
    return E.relative_mse(errors(spark, d)).withColumn("relative", r8("relative"))


_J03 = """ select panel_id, target, h, ds, model, y_true, y_pred, err, err_b
from (select *, max(case when model = 'arp' then err end) over (partition by panel_id, target, h, ds) as err_b from e) where err_b is not null"""


@query("j03_against_benchmark", sql("brand", ERR + _J03, recursive=False))
def j03(spark, d):
    return E.against_benchmark(errors(spark, d))


@q("a03_all_targets", f", m as (select panel_id, model, h, ds, avg(err) as err from e group by all), a as (select panel_id, model, h, round({SQ}, 6) as mse_of_mean from m group by all), t as (select panel_id, model, target, h, {SQ} as mse from e group by all), b as (select panel_id, model, h, round(avg(mse), 6) as mean_of_mse from t group by all) select * from a join b using (panel_id, model, h)")
def a03(spark, d):
    return E.all_targets(errors(spark, d)).withColumns({c: F.round(c, 6) for c in ("mse_of_mean", "mean_of_mse")})


@query("a04_totals", sql("brand", ERR + f", o as (select 'order' as panel_id, o_orderpriority as series, date_trunc('month', o_orderdate)::date as ds, sum(o_totalprice::decimal(18,2))::double / 1000 as value from orders group by all), " + _errors_sql("o", name="eo")[2:] + f", x as (select * from e union all select * from eo) select coalesce(panel_id, 'all') as panel_id, model, h, coalesce(target, 'all') as target, round({SQ}, 4) as mse from x group by grouping sets ((panel_id, model, h, target), (model, h, target), (panel_id, model, h))"))
def a04(spark, d):
    both = errors(spark, d).unionByName(E.simple_errors(panel(spark, d, "order"), (1, 3), M))
    return E.totals(both).withColumn("mse", F.round("mse", 4))


@q("a05_in_sample_stats", "select panel_id, model, target, h, round(avg(err), 8) + 0.0 as mean, round(var_pop(err), 6) as variance from e group by all")
def a05(spark, d):
    return errors(spark, d).groupBy(*UNIT).agg(r8(F.avg("err")).alias("mean"), F.round(F.var_pop("err"), 6).alias("variance"))


@q("a06_scores", _errors_sql(m=2 * M, name="w") + f", t as (select panel_id, model, target, h, {SQ} as mse_in from w anti join e using (panel_id, model, target, h, ds) group by all), s as (select panel_id, model, target, h, {SQ} as mse, round(sqrt({SQ}), 6) as rmse, round(median(abs(err)), 8) as medae, round(100 * avg(abs(err) / abs(y_true)), 6) as mape, round(200 * avg(abs(err) / (abs(y_true) + abs(y_pred))), 6) as smape, round(abs(corr(y_true, y_pred)), 6) as abs_corr, round(1 - regr_slope(y_pred, y_true), 6) as slope_gap from e group by all) select s.* exclude (mse), round(mse, 6) as mse, round(mse / nullif(mse_in, 0), 6) as fit_ratio from s left join t using (panel_id, model, target, h)")
def a06(spark, d):
    test = errors(spark, d)
    both = E.simple_errors(dense(spark, d, "brand"), (1, 3), 2 * M)
    train = both.join(test.select(*UNIT, "ds"), [*UNIT, "ds"], "left_anti")  # the errors of the years before
    out = E.scores(test, train=train)
    return out.select(*UNIT, *[F.round(c, 8 if c == "medae" else 6).alias(c) for c in out.columns if c not in UNIT])


@q("a06_accuracy", ", b as (select panel_id, target, h, ds, arg_min(model, (abs(err), model)) as y_true from e group by all), l as (select *, lag(y_true) over (partition by panel_id, target, h order by ds) as y_pred from b) select panel_id, h, round(avg((y_true = y_pred)::int), 8) as accuracy, count(*) as n from l where y_pred is not null group by all")
def a06_accuracy(spark, d):
    best = E.best_models(errors(spark, d)).withColumnRenamed("model", "y_true")
    before = F.lag("y_true").over(Window.partitionBy("panel_id", "target", "h").orderBy("ds"))  # yesterday's best model as the guess
    return E.accuracy(best.withColumn("y_pred", before), ("panel_id", "h")).withColumn("accuracy", r8("accuracy"))


@q("a12_win_counts", ", b as (select panel_id, target, h, ds, arg_min(model, (abs(err), model)) as model from e group by all) select panel_id, h, model, count(*) as wins from b group by all")
def a12(spark, d):
    return E.win_counts(errors(spark, d))


@q("w24_rank_models", ", r as (select *, row_number() over (partition by panel_id, target, h, ds order by abs(err), model) as n from e) select panel_id, target, h, ds, model, err from r where n = 1")
def w24(spark, d):
    return E.best_models(errors(spark, d))


@q("w25_oracle_best_mse", f", r as (select *, row_number() over (partition by panel_id, target, h, ds order by abs(err), model) as n from e) select panel_id, target, h, round({SQ}, 6) as mse from r where n = 1 group by all")
def w25(spark, d):
    return E.best_models(errors(spark, d)).groupBy("panel_id", "target", "h").agg(F.round(F.avg(F.col("err") ** 2), 6).alias("mse"))


@q("w26_best_model_labels", ", r as (select *, row_number() over (partition by panel_id, target, h, ds order by abs(err), model) as n from e), l as (select panel_id, target as series, ds, list_position(['arp', 'ma3', 'rw'], model) - 1 as label from r where n = 1 and h = 1), f as (select panel_id, series, ds, lag(value, 1) over (partition by panel_id, series order by ds) as value_lag1, lag(value, 2) over (partition by panel_id, series order by ds) as value_lag2 from d) select panel_id, series, ds, value_lag1, value_lag2, label::int as label from l join f using (panel_id, series, ds)")
def w26(spark, d):
    from ..operators.features import lag_features

    best = E.best_models(errors(spark, d)).where("h = 1").withColumnRenamed("target", "series")
    index = F.array_position(F.array(*map(F.lit, ("arp", "ma3", "rw"))), F.col("model")) - 1
    feats = lag_features(dense(spark, d, "brand"), 2).drop("value")
    return feats.join(best.select("panel_id", "series", "ds", index.cast("int").alias("label")), ["panel_id", "series", "ds"])


@q("a13_pivot_models", "select panel_id, target, h, ds, y_true as truth, max(y_pred) filter (model = 'rw') as rw, max(y_pred) filter (model = 'ma3') as ma3, max(y_pred) filter (model = 'arp') as arp from e group by all")
def a13(spark, d):
    return E.pivot_models(errors(spark, d), ("rw", "ma3", "arp"))


@q("a14_results_table", ", r as (select e.panel_id, e.model, e.target, e.h, avg(e.err * e.err) / avg(b.err * b.err) as relative from e join e b using (panel_id, target, h, ds) where b.model = 'arp' group by all) select panel_id, model, h, " + ", ".join(f"round(max(relative) filter (target = 'Brand#{i}'), 8) as \"Brand#{i}\"" for i in range(1, 26)) + " from r group by all")
def a14(spark, d):
    names = [f"Brand#{i}" for i in range(1, 26)]
    return E.results_table(errors(spark, d), names).withColumns({c: r8(f"`{c}`") for c in names})


@q("a15_distinct_models", "select distinct model from e")
def a15(spark, d):
    return errors(spark, d).select("model").distinct()


@q("a18_combine_forecasts", f", c as (select panel_id, target, h, ds, avg(err) as err, count(err) as n from e where model in ('rw', 'ma3') group by all) select panel_id, target, h, round({SQ}, 6) as mse, count(*) as n from c where n = 2 group by all")
def a18(spark, d):
    return E.combine(errors(spark, d), ("rw", "ma3")).withColumn("mse", F.round("mse", 6))


@q("p10_filter_errors", "select panel_id, ds, y_true, y_pred, err from e where target = 'Brand#12' and h = 3 and model = 'ma3'")
def p10(spark, d):
    return errors(spark, d).where("target = 'Brand#12' and h = 3 and model = 'ma3'").drop("target", "h", "model")


@q("u01_append_errors", "select panel_id, model, target, h, ds, err from e where model = 'rw' union all select panel_id, model, target, h, ds, err from e where model <> 'rw'")
def u01(spark, d):
    e = errors(spark, d).select(*UNIT, "ds", "err")
    return e.where("model = 'rw'").unionByName(e.where("model <> 'rw'"))


@q("j06_open_work", ", w as (select distinct panel_id, model, target, h from e) select * from w where not (model = 'rw' and h = 1)")
def j06(spark, d):
    work = errors(spark, d).select(*UNIT).distinct()
    return E.open_work(work, work.where("model = 'rw' and h = 1"), UNIT)


@q("j09_errors_to_predictions", "select panel_id, model, target, h, ds, y_true as truth, round(y_true - err, 6) as y_pred from e")
def j09(spark, d):
    truth = dense(spark, d, "brand").select("panel_id", F.col("series").alias("target"), "ds", F.col("value").alias("truth"))
    return E.errors_to_predictions(errors(spark, d), truth).withColumn("y_pred", F.round("y_pred", 6))


CRISIS_SQL = _CRISIS = f", c as (select distinct unnest(generate_series(a, b, interval 1 month))::date as ds from {RECESSIONS_SQL}), cal as (select distinct ds as date, case when ds in (select ds from c) then 'crisis' else 'non-crisis' end as crisis from d)"


def calendar(spark, d):
    dates = dense(spark, d, "brand").select("ds").distinct()
    flagged = C.crisis_flag(dates, C.crisis_months(recessions(spark)))
    return flagged.select(F.col("ds").alias("date"), F.when(F.col("crisis") == 1, "crisis").otherwise("non-crisis").alias("crisis"))


@query("s09_date_crisis_calendar", sql("brand", _CRISIS + " select * from cal"))
def s09(spark, d):
    return calendar(spark, d).distinct().orderBy("date")


@q("s08_to_error_rows", _CRISIS + ", k as (select *, row_number() over (order by date) as n from cal), n as (select *, row_number() over (partition by panel_id, model, target, h order by ds) as n from e) select 'run' as filename, model as model_name, 192 as start, 'h' || h as horizon, target as target_var, 'simple' as model_label, date, crisis, err as \"values\" from n join k using (n)")
def s08(spark, d):
    return E.to_error_rows(errors(spark, d), calendar(spark, d), "simple", 192, "run")


_DM_TERMS = " + ".join(f"2 * greatest(0, 1 - {j} / b) * coalesce(sum(u * u{j}), 0)" for j in range(1, 7))
_DM = ", x as (select e.panel_id, e.model, e.target, e.h, ds, e.err * e.err - b.err * b.err as d from e join e b using (panel_id, target, h, ds) where b.model = 'arp' and e.model <> 'arp'), v as (select *, d - avg(d) over p as u, count(*) over p as m, floor(4 * pow(count(*) over p / 100, 2.0 / 9)) + 1 as b from x window p as (partition by panel_id, model, target, h)), l as (select *, " + ", ".join(f"lag(u, {j}) over w as u{j}" for j in range(1, 7)) + f" from v window w as (partition by panel_id, model, target, h order by ds)), s as (select panel_id, model, target, h, m, avg(d) as dm, sqrt((sum(u * u) + {_DM_TERMS}) / m / m) as se from l group by panel_id, model, target, h, m, b) select panel_id, model, target, h, m, round(dm, 4) as dm, round(se, 4) as se, round(dm / se, 6) as t from s"


@q("t04_dm_test", _DM)
def t04(spark, d):
    out = E.dm_test(errors(spark, d))
    return out.select(*UNIT, "m", F.round("dm", 4).alias("dm"), F.round("se", 4).alias("se"), F.round("t", 6).alias("t"))


_PP_TERMS = " + ".join(f"2 * greatest(0, 1 - {j} / (l + 1)) * coalesce(sum(u * u{j}), 0)" for j in range(1, 7))
_PP = ", x as (select *, lag(value, 1) over (partition by panel_id, series order by ds) as x from d), y as (select * from x where x is not null and value is not null), f as (select panel_id, series, regr_slope(value, x) as rho, regr_intercept(value, x) as a, regr_sxx(value, x) as sxx, count(*) as n, floor(4 * pow(count(*) / 100, 0.25)) as l from y group by all), r as (select *, value - a - rho * x as u from y join f using (panel_id, series)), gl as (select *, " + ", ".join(f"lag(u, {j}) over w as u{j}" for j in range(1, 7)) + f" from r window w as (partition by panel_id, series order by ds)), s as (select panel_id, series, rho, sxx, n, sum(u * u) / n as g0, (sum(u * u) + {_PP_TERMS}) / n as lam, sum(u * u) / (n - 2) as s2 from gl group by panel_id, series, rho, sxx, n, l) select panel_id, series, n, round(sqrt(g0 / lam) * (rho - 1) / sqrt(s2 / sxx) - (lam - g0) / (2 * sqrt(lam)) * n * sqrt(s2 / sxx) / sqrt(s2), 6) as z_t, round(-2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3, 8) as critical from s"


@query("t02_phillips_perron", sql("brand", _PP))
def t02(spark, d):
    return E.phillips_perron(dense(spark, d, "brand")).withColumns({"z_t": F.round("z_t", 6), "critical": r8("critical")})


_BOOT = """with recursive t as (select count(distinct date_trunc('month', l_shipdate))::bigint as t from lineitem),
g as (select (i // t)::int as b, (i %% t)::int as t, t as n from t, range(0, 20 * t) r(i)),
h as (select *, ((b * 7919 + t * 104729 + 8)::bigint * 1103515245 + 12345) %% 2147483647 * 48271 %% 2147483647 as h1, ((b * 7919 + t * 104729 + 9)::bigint * 1103515245 + 12345) %% 2147483647 * 48271 %% 2147483647 as h2 from g),
s as (select *, case when {} then h2 %% n end as start, case when {} then t end as frm from h)
select b, t, ((last_value(start ignore nulls) over w + t - last_value(frm ignore nulls) over w) %% n)::int as i from s window w as (partition by b order by t rows unbounded preceding)""".replace("%%", "%")


def _months(spark, d):
    return panel(spark, d, "flag").select("ds").distinct().count()


@query("t05_bootstrap_block", _BOOT.format("t % 6 = 0", "t % 6 = 0"))
def t05(spark, d):
    return E.bootstrap_index(spark, _months(spark, d), 20, 6)


@query("t05_bootstrap_stationary", _BOOT.format("t = 0 or h1 % 6 = 0", "t = 0 or h1 % 6 = 0"))
def t05s(spark, d):
    return E.bootstrap_index(spark, _months(spark, d), 20, 6, "stationary")


@q("t07_evaluate", _CRISIS + f", x as (select 'full' as part, * from e union all select 'crisis', * from e where ds in (select ds from c) union all select 'non-crisis', * from e where ds not in (select ds from c)) select x.part, x.panel_id, x.model, x.target, x.h, round(avg(x.err * x.err), 4) as mse, round(avg(case when b.err is not null then x.err * x.err end) / avg(b.err * b.err), 6) as relative from x left join (select * from e where model = 'arp') b using (panel_id, target, h, ds) group by all")
def t07(spark, d):
    from ..plans.report import evaluate

    out = evaluate(errors(spark, d), C.crisis_months(recessions(spark)))
    return out.select("part", *UNIT, F.round("mse", 4).alias("mse"), F.round("relative", 6).alias("relative"))


# --- selections: the five largest brands of each month stand for a selection ------------------------
SELECTION_SQL = _SEL = ", r as (select *, row_number() over (partition by ds order by value desc, series) as n from p), s as (select ds as window_id, 'Brand#' || (1 + month(ds) % 3) as target, series as base, case when n % 2 = 0 then 'dif_log' else 'lvl' end as transform, n from r where n <= 5)"


def selection(spark, d):
    n = F.row_number().over(Window.partitionBy("ds").orderBy(F.desc("value"), "series"))
    s = panel(spark, d, "brand").withColumn("n", n).where("n <= 5")
    target = F.concat(F.lit("Brand#"), (1 + F.month("ds") % 3).cast("string"))
    return s.select(F.col("ds").alias("window_id"), target.alias("target"), F.col("series").alias("base"), F.when(F.col("n") % 2 == 0, "dif_log").otherwise("lvl").alias("transform"), "n")


@query("a08_selection_counts", sql("brand", _SEL + " select window_id, transform, count(*) as n from s group by all"))
def a08(spark, d):
    return E.selection_counts(selection(spark, d), "transform")


@query("a09_resample_quarter", sql("brand", _SEL + " select date_trunc('quarter', window_id)::date as quarter, base, count(*) as n from s group by all"))
def a09(spark, d):
    return E.resample_quarter(E.selection_counts(selection(spark, d), "base"), "base")


@query("a10_minmax_normalise", sql("brand", _SEL + ", c as (select base, count(*) as n from s group by all) select base, n, round((n - min(n) over ()) / nullif(max(n) over () - min(n) over (), 0), 8) as scaled from c"))
def a10(spark, d):
    counts = selection(spark, d).groupBy("base").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    return E.minmax_normalise(counts, "n", "k").drop("k").withColumn("scaled", r8("scaled"))


@query("a11_min_selected", sql("brand", _SEL + ", w as (select distinct 'Brand#' || (1 + month(ds) % 3) as target, ds as window_id from p), c as (select target, window_id, count(*) as n from s where month(window_id) <> 6 group by all) select target, min(coalesce(n, 0)) as least from w left join c using (target, window_id) group by target having min(coalesce(n, 0)) < 5"))
def a11(spark, d):
    every = selection(spark, d)
    return E.min_selected(every.where("month(window_id) <> 6"), every, 5)  # nothing is selected in June


@query("k04_selection_code", sql("brand", _SEL + ", b as (select distinct series as base from p), w as (select distinct window_id from s) select 'brand' as panel_id, w.window_id, b.base, coalesce(min(case transform when 'lvl' then 1 when 'dif_log' then 5 end), 0) as code from w cross join b left join s on s.window_id = w.window_id and s.base = b.base group by all"))
def k04(spark, d):
    from ..operators.select import selection_codes

    return selection_codes(selection(spark, d).withColumn("panel_id", F.lit("brand")), panel(spark, d, "brand").select("panel_id", F.col("series").alias("base")))


_LMAX = """, x as (select x.panel_id, o.series as target, x.series, x.value, o.value as y from p x join p o using (panel_id, ds) where x.series <> o.series),
s as (select panel_id, target, series, count(*) as n, regr_sxy(y, value) as sxy, regr_sxx(y, value) as sxx from x group by all having count(*) > 1 and regr_sxx(y, value) > 0),
mx as (select panel_id, target, max(abs(sxy / sqrt(sxx / (n - 1))) / n) as top from s group by all)
select panel_id, target, i.i as idx, round(top / 1.0 * (1 - i.i * (1 - 1e-4) / 199), 8) as lambda from mx, range(0, 200) i(i)"""


@query("c01_lambda_grid", sql("region", _LMAX))
def c01(spark, d):
    return L.lambda_grid(panel(spark, d, "region")).withColumn("lambda", r8("lambda"))


_IC = ", x as (select *, lag(value, k.k::int) over (partition by panel_id, series, k.k order by ds) as x from d, range(1, 7) k(k)), f as (select panel_id, series, k, regr_count(value, x) as n, regr_syy(value, x) - pow(regr_sxy(value, x), 2) / regr_sxx(value, x) as ssr from x group by all), c as (select *, round(ln(ssr / n) + 2 * ln(n) / n, 8) as bic from f) select panel_id, series, arg_min(k, (bic, k))::int as k from c group by all"


@query("a17_argmin_ic", sql("flag", _IC))
def a17(spark, d):
    obs = dense(spark, d, "flag").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    w = Window.partitionBy("panel_id", "series", "k").orderBy("ds")
    lagged = F.coalesce(*[F.when(F.col("k") == k, F.lag("value", k).over(w)) for k in range(1, 7)])
    fit = obs.withColumn("x", lagged).groupBy("panel_id", "series", "k").agg(
        F.regr_count("value", "x").alias("n"), (F.regr_syy("value", "x") - F.regr_sxy("value", "x") ** 2 / F.regr_sxx("value", "x")).alias("ssr")
    )
    bic = fit.withColumn("bic", r8(F.ln(F.col("ssr") / F.col("n")) + 2 * F.ln("n") / F.col("n")))
    return E.argmin_ic(bic, ["panel_id", "series"], "k", "bic")
