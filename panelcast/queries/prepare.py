"""Projections, filters, joins, transforms and cleaning (groups P, J, W, N, D, U of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import transforms as T
from ..operators import calendar as C
from ..operators import features as X
from ..plans.panels import RECESSIONS_SQL, dense, panel, recessions, sql, table
from ..sources.io import cut
from .registry import query, r8

KEYS = ["panel_id", "series", "ds"]
WIN = "window w as (partition by panel_id, series order by ds), a as (partition by panel_id, series)"


# --- transforms ---------------------------------------------------------------------------------
_FORMULA = {
    1: "value",
    2: "value - lag(value, 1) over w",
    3: "value - 2 * lag(value, 1) over w + lag(value, 2) over w",
    4: "case when min(value) over a >= 1e-6 then ln(value) end",
    5: "case when min(value) over a > 1e-6 then ln(value) - ln(lag(value, 1) over w) end",
    6: "case when min(value) over a > 1e-6 then ln(value) - 2 * ln(lag(value, 1) over w) + ln(lag(value, 2) over w) end",
    7: "(value - lag(value, 1) over w) / lag(value, 1) over w - (lag(value, 1) over w - lag(value, 2) over w) / lag(value, 2) over w",
    8: "100 * (value - lag(value, 12) over w) / abs(lag(value, 12) over w)",
    9: "value - lag(value, 12) over w",
    10: "100 * (value - lag(value, 3) over w) / abs(lag(value, 3) over w)",
    11: "value - lag(value, 3) over w",
}


def _transform_query(code: int) -> None:
    body = f"select panel_id, series, ds, round({_FORMULA[code]}, 8) + 0.0 as value from d {WIN}"

    @query(f"w{code:02d}_{T.NAMES[code]}", sql("supp", body))
    def run(spark, d):
        return dense(spark, d, "supp").select(*KEYS, r8(T.transform(code)).alias("value"))


for _code in _FORMULA:
    _transform_query(_code)

_BOX = """, k as (
  select panel_id, series, x.value, l.i / 10.0::double as lam
  from (select *, min(value) over (partition by panel_id, series) as least from d where value is not null) x, range(-20, 21) l(i)
  where least > 1e-6),
y as (select *, case when abs(lam) < 1e-9 then ln(value) else (pow(value, lam) - 1) / lam end as bc from k),
f as (select panel_id, series, lam, -count(*) / 2 * ln(var_pop(bc)) + (lam - 1) * sum(ln(value)) as ll from y group by panel_id, series, lam),
b as (select panel_id, series, arg_max(lam, ll) as lam from f group by all)
select panel_id, series, ds, lam,
       round(case when abs(lam) < 1e-9 then ln(value) else (pow(value, lam) - 1) / lam end, 6) + 0.0 as value
from d left join b using (panel_id, series)"""


@query("w12_box", sql("brand", _BOX))
def w12(spark, d):
    return T.box_cox(dense(spark, d, "brand")).select(*KEYS, "lam", (F.round("box", 6) + F.lit(0.0)).alias("value"))


_DETREND = f""", n as (select *, row_number() over w as n from d {WIN.split(', a as')[0]}),
m as (select *, min(case when value is not null then n end) over (partition by panel_id, series) as f from n)
select panel_id, series, ds, round(case when n - f < 12 then value
  when count(value) over q = 12 then value - avg(value) over q end, 8) + 0.0 as value
from m window q as (partition by panel_id, series order by ds rows between 12 preceding and 1 preceding)"""


@query("w13_detrended", sql("supp", _DETREND))
def w13(spark, d):
    return T.detrended(dense(spark, d, "supp"), "value", "y").select(*KEYS, r8("y").alias("value"))


_ALL7 = ", t as (select panel_id, series, ds, " + ", ".join(f"{_FORMULA[c]} as c{c}" for c in range(1, 8)) + f" from d {WIN}) " + " union all ".join(
    f"select panel_id, series, ds, '{T.NAMES[c]}' as transform, round(c{c}, 8) + 0.0 as value from t" for c in range(1, 8)
)


@query("w_all_7", sql("brand", _ALL7))
def w_all_7(spark, d):
    return T.apply_all(dense(spark, d, "brand")).select(*KEYS, "transform", r8("value").alias("value"))


_ALL24 = _BOX[: _BOX.index("select panel_id, series, ds, lam,")].rstrip() + ", x24 as (select panel_id, series, ds, " + ", ".join(f"{_FORMULA[c]} as c{c}" for c in range(1, 12)) + f" from d {WIN}), b24 as (select panel_id, series, ds, case when abs(lam) < 1e-9 then ln(value) else (pow(value, lam) - 1) / lam end as c12 from d left join b using (panel_id, series)), u24 as materialized (" + " union all ".join(f"select panel_id, series, ds, '{T.NAMES[c]}' as transform, c{c} as value from {'b24' if c == 12 else 'x24'}" for c in range(1, 13)) + """),
n24 as (select *, row_number() over (partition by panel_id, series, transform order by ds) as n from u24),
m24 as (select *, min(case when value is not null then n end) over (partition by panel_id, series, transform) as f from n24)
select panel_id, series, ds, transform, round(value, case transform when 'box' then 5 else 8 end) + 0.0 as value from u24
union all
select panel_id, series, ds, transform || '_detrended', round(case when n - f < 12 then value
  when count(value) over q = 12 then value - avg(value) over q end, case transform when 'box' then 5 else 8 end) + 0.0
from m24 window q as (partition by panel_id, series, transform order by ds rows between 12 preceding and 1 preceding)"""


@query("w_all_24", sql("brand", _ALL24))
def w_all_24(spark, d):
    rounded = F.when(F.col("transform").startswith("box"), F.round("value", 5)).otherwise(F.round("value", 8)) + F.lit(0.0)
    return T.apply_all(dense(spark, d, "brand"), tuple(range(1, 13)), detrend=True).select(*KEYS, "transform", rounded.alias("value"))


_TCODE = ", t as (select panel_id, series, ds, substr(series, 7)::int % 7 + 1 as tcode, " + ", ".join(f"{_FORMULA[c]} as c{c}" for c in range(1, 8)) + f" from d {WIN}) select panel_id, series, ds, case tcode " + " ".join(f"when {c} then '{T.NAMES[c]}'" for c in range(1, 8)) + " end as transform, round(case tcode " + " ".join(f"when {c} then c{c}" for c in range(1, 8)) + " end, 8) + 0.0 as value from t"


@query("j01_apply_tcode", sql("brand", _TCODE))
def j01(spark, d):
    meta = table(spark, d, "part").select(F.lit("brand").alias("panel_id"), F.col("p_brand").alias("series")).distinct().withColumn("tcode", F.substring("series", 7, 9).cast("int") % 7 + 1)
    return T.apply_tcode(dense(spark, d, "brand"), meta).select(*KEYS, "transform", r8("value").alias("value"))


# --- projections and filters --------------------------------------------------------------------
@query("p01_clip_sample", sql("supp", "select * from p where ds between date '1996-01-01' and date '1997-12-01'"))
def p01(spark, d):
    return C.clip_sample(panel(spark, d, "supp"), "1996-01-01", "1997-12-01")


@query("p02_densify", sql("supp", "select * from d"))
def p02(spark, d):
    return dense(spark, d, "supp")


_HOUR = """with p as (
  select 'event' as panel_id, event_type as series, date_trunc('hour', ts)::timestamp as ds, round(avg(value), 6) as value from events group by all),
g as (select panel_id, series, unnest(generate_series(min(ds), max(ds), interval 1 hour)) as ds from p group by panel_id, series)
select g.panel_id, g.series, g.ds::varchar as ds, p.value from g left join p using (panel_id, series, ds)"""


@query("p02_densify_hourly", _HOUR)
def p02_hourly(spark, d):
    hours = table(spark, d, "events").groupBy(F.lit("event").alias("panel_id"), F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ds"))
    obs = hours.agg(F.round(F.avg("value"), 6).alias("value"))
    return C.densify(obs, "hour").withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))


def _late(spark, d):
    """The part panel with every tenth part blanked before 1998."""
    obs = dense(spark, d, "part")
    early = (F.col("series").cast("long") % 10 == 0) & (F.col("ds") < "1998-01-01")
    return obs.withColumn("value", F.when(~early, F.col("value")))


_LATE = ", l as (select panel_id, series, ds, case when series::bigint % 10 = 0 and ds < date '1998-01-01' then null else value end as value from d)"


@query("p03_drop_all_missing", sql("part", _LATE + ", q as (select * from l where ds < date '1998-01-01') select * from q where series in (select series from q group by series having count(value) > 0)"))
def p03(spark, d):
    return C.drop_all_missing(_late(spark, d).where("ds < date'1998-01-01'"))


_HEAD = _LATE + """, n as (select *, row_number() over (partition by panel_id, series order by ds) as n, count(*) over (partition by panel_id, series) as t from l),
h as (select *, avg(case when n <= least(ceil((t - 24) * 0.81 / 100) * 100, t) then (value is null)::int end) over (partition by panel_id, series) as share from n)
select panel_id, series, ds, value from h where share is null or share <= 0.8"""


@query("p04_drop_sparse_head", sql("part", _HEAD, recursive=False))
def p04(spark, d):
    return C.drop_sparse_head(_late(spark, d), 24, 0.9)


@query("p05_drop_incomplete", sql("supp", "select * from d where series in (select series from d group by series having count(value) = count(*))"))
def p05(spark, d):
    return C.drop_incomplete(dense(spark, d, "supp"))


_TRIM = """, s as (select panel_id, ds, avg((value is null)::int) as share from d group by all),
b as (select panel_id, min(ds) as a, max(ds) as b from s where not ({}) group by panel_id)
select d.* from d join b using (panel_id) where ds between a and b"""


@query("p06_trim_bad_edges", sql("part", _TRIM.format("share > 0.7")))
def p06(spark, d):
    return C.trim_bad_edges(dense(spark, d, "part"), 0.7)


@query("p06b_trim_all_missing", sql("part", _TRIM.format("share >= 1")))
def p06b(spark, d):
    return C.trim_bad_edges(dense(spark, d, "part"), all_missing=True)


@query("p07_oos_period", sql("supp", ", n as (select distinct panel_id, ds from d), r as (select *, row_number() over (partition by panel_id order by ds desc) as n from n) select panel_id, min(ds) as first_ds, max(ds) as last_ds from r where n <= 24 group by panel_id"))
def p07(spark, d):
    return C.oos_period(dense(spark, d, "supp"), 24)


@query("p08_resolve_targets", "select distinct p_brand as target, p_brand || '_dif_log' as name from part where p_brand in ('Brand#1', 'Brand#12', 'Brand#25')")
def p08(spark, d):
    known = table(spark, d, "part").select(F.col("p_brand").alias("base")).distinct().withColumn("name", T.joined_name(F.col("base"), F.lit("dif_log")))
    return N.resolve_targets(known, ["Brand#1", "Brand#12", "Brand#25"])


@query("p09_split_name", "select distinct p_brand || '_dif_log' as name, p_brand as base, 'dif_log' as suffix from part")
def p09(spark, d):
    made = table(spark, d, "part").select(T.joined_name(F.col("p_brand"), F.lit("dif_log")).alias("name")).distinct()
    return made.select("name", N.base_name(F.col("name")).alias("base"), N.suffix(F.col("name")).alias("suffix"))


@query("p12_drop_first", sql("supp", ", n as (select *, row_number() over (partition by panel_id, series order by ds) as n from d) select panel_id, series, ds, value from n where n > 2"))
def p12(spark, d):
    return C.drop_first(dense(spark, d, "supp"), 2)


# --- joins --------------------------------------------------------------------------------------
@query("j02_group_map", sql("brand", "select panel_id, 'group' || (substr(series, 7)::int % 5) as var_group, ds, count(*) as n, round(sum(value), 6) as total from p group by all"))
def j02(spark, d):
    groups = table(spark, d, "part").select(F.col("p_brand").alias("series")).distinct()
    groups = groups.withColumn("var_group", F.concat(F.lit("group"), (F.substring("series", 7, 9).cast("int") % 5).cast("string")))
    joined = panel(spark, d, "brand").join(groups, "series")  # a row for each brand name
    return joined.groupBy("panel_id", "var_group", "ds").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


_CRISIS = f", c as (select distinct unnest(generate_series(a - interval 2 month, b + interval 3 month, interval 1 month))::date as ds from {RECESSIONS_SQL})"


@query("j04_crisis_months", sql("flag", _CRISIS + " select d.panel_id, d.series, d.ds, (c.ds is not null)::int as crisis from d left join c using (ds)"))
def j04(spark, d):
    return C.crisis_flag(dense(spark, d, "flag"), C.crisis_months(recessions(spark), 2, 3)).select(*KEYS, "crisis")


_HELD = """with i as (select user_id, ts as a, ts + to_microseconds((900 + 90 * abs(value))::bigint * 1000000) as b from events where event_type = 'error' and value is not null)
select event_id, (select count(*) from i where i.user_id = e.user_id and e.ts between a and b) as n_intervals, (exists (select 1 from i where i.user_id = e.user_id and e.ts between a and b))::int as crisis from events e"""


@query("j04_interval_flag", _HELD)
def j04i(spark, d):
    """Events inside the incidents of their user; an incident opens with an error and lasts some seconds by its value."""
    rows = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    lasts = F.timestamp_micros(F.unix_micros(ts) + F.rint(F.lit(900) + 90 * F.abs("value")).cast("long") * 1_000_000)  # halves to even, as SQL's cast
    incidents = rows.where("event_type = 'error' and value is not null").select("user_id", ts.alias("start"), lasts.alias("end"))
    held = C.interval_flag(rows.select("event_id", "user_id", ts.alias("ts")), incidents, ["user_id"], "ts", 7200.0)
    return held.select("event_id", "n_intervals", "crisis")


@query("u04_unique_crisis_months", sql("flag", _CRISIS + " select ds from c where ds in (select ds from d)"))
def u04(spark, d):
    dates = dense(spark, d, "flag").select("ds").distinct()
    return C.crisis_months(recessions(spark), 2, 3).join(dates, "ds", "left_semi")


@query("j05_horizon_pairs", sql("supp", ", q as (select panel_id, series, ds, value as x, lead(value, 3) over w as y, lead(ds, 3) over w as target_ds from d window w as (partition by panel_id, series order by ds)) select * from q where target_ds is not null"))
def j05(spark, d):
    return C.horizon_pairs(dense(spark, d, "supp"), 3)


_ROLL = ", n as (select *, row_number() over (partition by panel_id, series order by ds) as s, count(*) over (partition by panel_id, series) as t from d) select panel_id, series, ds, s, w.w as window_id, value from n join range(1, 25) w(w) on s between w.w and t - 24 + w.w - 3 where t > 27"


@query("j07_rolling_windows", sql("flag", _ROLL))
def j07(spark, d):
    return C.rolling_windows(dense(spark, d, "flag"), 24, 3)


_ALIGN = ", o as (select distinct date_trunc('month', o_orderdate)::date as ds from orders)"


@query("j08_align_periods", sql("flag", _ALIGN + " select d.* from d join o using (ds)"))
def j08(spark, d):
    return dense(spark, d, "flag").join(panel(spark, d, "order").select("ds").distinct(), "ds").select(*KEYS, "value")


@query("u02_common_months", sql("flag", _ALIGN + " select ds from d intersect select ds from o"))
def u02(spark, d):
    return dense(spark, d, "flag").select("ds").intersect(panel(spark, d, "order").select("ds"))


@query("u03_non_crisis_months", sql("flag", _CRISIS + " select ds from d except select ds from c"))
def u03(spark, d):
    return dense(spark, d, "flag").select("ds").subtract(C.crisis_months(recessions(spark), 2, 3).select("ds"))


@query("p11_split_sample", sql("flag", _CRISIS + " select 'crisis' as part, panel_id, series, ds, value from d where ds in (select ds from c) union all select 'non-crisis', panel_id, series, ds, value from d where ds not in (select ds from c) union all select 'full', panel_id, series, ds, value from d"))
def p11(spark, d):
    obs, crisis = dense(spark, d, "flag"), C.crisis_months(recessions(spark), 2, 3)
    parts = [C.split_sample(obs, crisis, k).select(F.lit(k).alias("part"), *KEYS, "value") for k in ("crisis", "non-crisis", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- window operators ---------------------------------------------------------------------------
_PCT = """, v as (select *, row_number() over (partition by panel_id, series order by value) as i, count(*) over (partition by panel_id, series) as n from d where value is not null),
x as (select *, greatest(1.0, least(n::double, n * {p} / 100 + 0.5)) as pos from v),
q{n} as (select panel_id, series, max(case when i = floor(pos) then value end) + (max(case when i = ceil(pos) then value end) - max(case when i = floor(pos) then value end)) * (max(pos) - floor(max(pos))) as q from x group by all)"""


@query("n03_matlab_percentile", sql("supp", _PCT.format(p=30.0, n="") + " select panel_id, series, round(q, 8) as q from q"))
def n03(spark, d):
    return C.matlab_percentile(dense(spark, d, "supp"), q=30.0).withColumn("q", r8("q"))


_OUT = "".join(_PCT.format(p=p, n=n).replace(" v as", f" v{n} as").replace("from v)", f"from v{n})").replace("\nx as", f"\nx{n} as").replace("from x group", f"from x{n} group") for p, n in ((25.0, 1), (50.0, 2), (75.0, 3))) + """
select d.panel_id, d.series, d.ds, coalesce(abs(value - q2.q) > 1.5 * (q3.q - q1.q), false) as is_outlier,
       case when not coalesce(abs(value - q2.q) > 1.5 * (q3.q - q1.q), false) then value end as cleaned
from d left join q1 using (panel_id, series) left join q2 using (panel_id, series) left join q3 using (panel_id, series)"""


@query("w14_flag_outliers", sql("supp", _OUT))
def w14(spark, d):
    return C.flag_outliers(dense(spark, d, "supp"), 1.5).select(*KEYS, "is_outlier", "cleaned")


_LINEAR = """, s as (select panel_id, series, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from d group by all)
select panel_id, series, count(*) as n, count(*) filter (abs(value - med) > 1.5 * iqr) as n_outlier from d join s using (panel_id, series) group by all"""


@query("a07_outlier_counts", sql("supp", _LINEAR))
def a07(spark, d):
    flagged = C.flag_outliers(dense(spark, d, "supp"), 1.5, "linear")
    return flagged.groupBy("panel_id", "series").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_outlier").cast("long")).alias("n_outlier"))


@query("a16_quartiles", sql("supp", "select panel_id, series, round(quantile_cont(value, 0.5), 8) as med, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) as iqr from d group by all"))
def a16(spark, d):
    q = lambda p: F.percentile("value", F.lit(p))
    return dense(spark, d, "supp").groupBy("panel_id", "series").agg(r8(q(0.5)).alias("med"), r8(q(0.75) - q(0.25)).alias("iqr"))


@query("w15_lag_features", sql("supp", "select panel_id, series, ds, " + ", ".join(f"lag(value, {k}) over w as value_lag{k}" for k in (1, 2, 3)) + " from d window w as (partition by panel_id, series order by ds)"))
def w15(spark, d):
    return X.lag_features(dense(spark, d, "supp"), 3).select(*KEYS, *[f"value_lag{k}" for k in (1, 2, 3)])


@query("w16_standardise", sql("supp", "select panel_id, series, ds, round((value - avg(value) over a) / stddev_samp(value) over a, 8) + 0.0 as value from d window a as (partition by panel_id, series)"))
def w16(spark, d):
    return X.standardise(dense(spark, d, "supp")).select(*KEYS, r8("value").alias("value"))


_SCALED = """, i as (select panel_id, series, ds, value, row_number() over (partition by panel_id, series order by ds) as s, count(*) over (partition by panel_id, series) as t from d),
e as (select * from i where t - 24 > 0 and s between t - 24 and t - 1),
w as (select e.panel_id, e.series, e.s, e.t, any_value(e.ds) as origin_ds, any_value(e.value) as value, count(i.value) as n, avg(i.value) as mean, stddev_samp(i.value) as sd
  from e join i on i.panel_id = e.panel_id and i.series = e.series and i.s between e.s - (e.t - 25) and e.s group by all)
select panel_id, series, (s - (t - 24) + 1)::int as window_id, origin_ds, n, round(mean, 6) as mean, round(sd, 6) as sd, round(case when sd > 1e-9 then (value - mean) / sd end, 6) + 0.0 as z from w"""


@query("w16_window_scaling", sql("supp", _SCALED))
def w16w(spark, d):
    out = X.window_scaling(dense(spark, d, "supp"), 24, 1)
    return out.select("panel_id", "series", "window_id", "origin_ds", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "sd", "z")])


_DEMEAN = "select panel_id, series, ds, 0 as mode, round(value, 8) as y from d union all select panel_id, series, ds, 1, round(value - avg(value) over (partition by panel_id, series), 8) + 0.0 from d union all select panel_id, series, ds, 2, round((value - avg(value) over (partition by panel_id, series)) / stddev_samp(value) over (partition by panel_id, series), 8) + 0.0 from d union all select panel_id, series, ds, 3, round((value - avg(value) over (partition by panel_id, series order by ds rows unbounded preceding)) / stddev_samp(value) over (partition by panel_id, series), 8) + 0.0 from d"


@query("w17_demean", sql("brand", _DEMEAN))
def w17(spark, d):
    obs = dense(spark, d, "brand")
    wide = obs.select(*KEYS, *[r8(X.demean(k)).alias(str(k)) for k in range(4)])
    return wide.unpivot(KEYS, ["0", "1", "2", "3"], "mode", "y").withColumn("mode", F.col("mode").cast("int"))


_EXP = "select panel_id, series, ds, " + ", ".join(f"case when row_number() over w > 5 then round({f}(value) over q, 8) else 0.0 end as {n}_before" for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"))) + " from d window w as (partition by panel_id, series order by ds), q as (partition by panel_id, series order by ds rows between unbounded preceding and 1 preceding)"


@query("w18_expanding_stats", sql("supp", _EXP))
def w18(spark, d):
    return X.expanding_stats(dense(spark, d, "supp")).select(*KEYS, *[r8(f"{k}_before").alias(f"{k}_before") for k in ("min", "mean", "max")])


_EMA = ", n as (select *, row_number() over (partition by panel_id, series order by ds) as i from p), e as (select panel_id, series, ds, i, value as ema from n where i = 1 union all select n.panel_id, n.series, n.ds, n.i, 0.2 * n.value + (1 - 0.2) * e.ema from n join e on n.panel_id = e.panel_id and n.series = e.series and n.i = e.i + 1) select panel_id, series, ds, round(ema, 8) as ema from e"


@query("w19_ema", sql("flag", _EMA))
def w19(spark, d):
    return X.ema(panel(spark, d, "flag")).select(*KEYS, r8("ema").alias("ema"))


_FFT = ", n as (select *, row_number() over (partition by panel_id, series order by ds) - 1 as i from p), pr as (select a.panel_id, a.series, a.ds, a.i as n, b.i as t, b.value as x from n a join n b on a.series = b.series and b.i < a.i) select panel_id, series, ds, k.k as term, round(sqrt(pow(sum(x * cos(2 * pi() * k.k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k.k * t / n)), 2)), 6) + 0.0 as amplitude from pr join range(0, 5) k(k) on k.k < n group by panel_id, series, ds, n, k.k"


@query("w20_fft_amplitudes", sql("flag", _FFT))
def w20(spark, d):
    return X.fft_amplitudes(panel(spark, d, "flag"), 5).withColumn("amplitude", F.round("amplitude", 6) + F.lit(0.0))


_SEAS = ", t as (select *, row_number() over w as n, (row_number() over w) % 12 as phase, case when count(value) over q = 12 then avg(value) over q end as trend from p window w as (partition by panel_id, series order by ds), q as (partition by panel_id, series order by ds rows between 11 preceding and current row)), s as (select *, avg(value - trend) over (partition by panel_id, series, phase order by ds rows unbounded preceding) as seasonal from t) select panel_id, series, ds, " + ", ".join(f"round(lag({c}) over w, 8) + 0.0 as {n}" for c, n in (("trend", "trend"), ("seasonal", "seasonal"), ("value - trend - seasonal", "residual"))) + " from s window w as (partition by panel_id, series order by ds)"


@query("w21_seasonal_decompose", sql("flag", _SEAS))
def w21(spark, d):
    return X.seasonal_decompose(panel(spark, d, "flag"), 12).select(*KEYS, *[r8(c).alias(c) for c in ("trend", "seasonal", "residual")])


_FILL = ", m as (select *, coalesce(value, quantile_cont(value, 0.5) over a) as f, row_number() over w as n, count(*) over a as t from d window w as (partition by panel_id, series order by ds), a as (partition by panel_id, series)) select panel_id, series, ds, round(coalesce(value, (sum(f) over q + greatest(0, 4 - n) * first_value(f) over o + greatest(0, 3 - (t - n)) * last_value(f) over o) / 7), 8) as filled from m window q as (partition by panel_id, series order by ds rows between 3 preceding and 3 following), o as (partition by panel_id, series order by ds rows between unbounded preceding and unbounded following)"


@query("w22_ma_fill", sql("supp", _FILL))
def w22(spark, d):
    return C.ma_fill(dense(spark, d, "supp")).select(*KEYS, r8("filled").alias("filled"))


@query("w23_spline_fill")
def w23(spark, d):
    return X.spline_fill(dense(spark, d, "part"))


@query("w23_fill_gaps")
def w23_modes(spark, d):
    obs, out = cut(dense(spark, d, "supp"), "gaps"), None  # for five ways and three edges
    for mode in range(1, 6):
        rows = X.fill_gaps(obs, mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("w27_trend_forecast", sql("supp", ", n as (select *, row_number() over (partition by panel_id, series order by ds)::double as t from p), s as (select *, regr_slope(value, t) over q as b, regr_intercept(value, t) over q as a, count(*) over q as n, avg(t) over q as mt, regr_sxx(value, t) over q as sxx, regr_syy(value, t) over q as syy, regr_sxy(value, t) over q as sxy from n window q as (partition by panel_id, series order by ds rows between unbounded preceding and 1 preceding)) select panel_id, series, ds, round(a + b * t, 7) as yhat, round(1.2815515655446004 * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) * sqrt(1 + 1 / n + (t - mt) * (t - mt) / sxx), 5) as half from s where n > 2"))
def w27(spark, d):
    out = X.trend_forecast(panel(spark, d, "supp"))
    return out.select(*KEYS, F.round("yhat", 7).alias("yhat"), F.round((F.col("upper") - F.col("lower")) / 2, 5).alias("half"))


# --- splits, dates, names -----------------------------------------------------------------------
_TSS = ", n as (select *, row_number() over (partition by panel_id, series order by ds) as s, count(*) over (partition by panel_id, series) as n from p), q as (select n.*, k.k, n // 6 as size, n - (6 - k.k) * (n // 6) as start from n, range(1, 6) k(k)) select panel_id, series, ds, k as split, case when s <= start then 'train' else 'test' end as part from q where s <= start + size"


@query("c04_time_series_split", sql("flag", _TSS))
def c04(spark, d):
    return C.time_series_split(panel(spark, d, "flag"), 5)


_BLOCK = ", t as (select panel_id, series, count(*) as t from p group by all), k as (select *, floor(t * 0.7)::int as train from t), b as (select *, floor((t - train - 6) / 5)::int as blocks from k), m as (select b.*, x.x as block from b join range(1, 100) x(x) on x.x <= blocks) select panel_id, series, block, (block - 1) * 5 + 1 as train_from, (block - 1) * 5 + train as train_to, (block - 1) * 5 + train + 3 + 1 as test_from, case when block = blocks then t - 3 else (block - 1) * 5 + train + 3 + 5 end as test_to from m"


@query("c02_block_splits", sql("flag", _BLOCK))
def c02(spark, d):
    lengths = panel(spark, d, "flag").groupBy("panel_id", "series").agg(F.count(F.lit(1)).alias("t"))
    return C.block_splits(lengths, 3, 0.7, 5)


@query("d01_decimal_date", sql("flag", "select distinct ds, year(ds) + month(ds) / 12.0 as dec, ds as back from d"))
def d01(spark, d):
    dates = dense(spark, d, "flag").select("ds").distinct().withColumn("dec", F.year("ds") + F.month("ds") / 12.0)
    return dates.withColumn("back", C.decimal_to_date(F.col("dec")))


@query("d02_year_fraction", "select o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31))::double, 8) as dec from orders")
def d02(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r8(C.date_to_decimal(F.col("o_orderdate"))).alias("dec"))


@query("d03_month_range", sql("flag", "select panel_id, series, min(ds) as a, max(ds) as b, datediff('month', min(ds), max(ds)) + 1 as n, (max(ds) + interval 3 month)::date as later from p group by all"))
def d03(spark, d):
    span = panel(spark, d, "flag").groupBy("panel_id", "series").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    return span.select("*", F.size(F.expr("sequence(a, b, interval 1 month)")).cast("long").alias("n"), F.add_months("b", 3).alias("later"))


@query("n01_strings", "select distinct p_type, regexp_replace(p_type, '[ &:]', '', 'g') as clean, split_part(p_type, ' ', 1) as head, regexp_extract('h12', '[0-9]+')::int as h from part")
def n01(spark, d):
    return table(spark, d, "part").select("p_type").distinct().select("p_type", N.clean_name(F.col("p_type")).alias("clean"), F.substring_index("p_type", " ", 1).alias("head"), N.horizon_of(F.lit("h12")).alias("h"))


@query("n02_math", "select o_orderkey, round(ln(o_totalprice), 8) as ln, abs(-o_totalprice) as abs, round(sqrt(o_totalprice), 8) as sqrt, round(o_totalprice / 1000) as round, floor(o_totalprice)::bigint as floor, ceil(o_totalprice)::bigint as ceil from orders where o_totalprice > 0")
def n02(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").where(x > 0).select("o_orderkey", r8(F.ln(x)).alias("ln"), F.abs(-x).alias("abs"), r8(F.sqrt(x)).alias("sqrt"), F.round(x / 1000).alias("round"), F.floor(x).alias("floor"), F.ceil(x).alias("ceil"))


@query("n05_json_state", "select user_id, count(*) as n, max(event_id) as last_id from events group by user_id")
def n05(spark, d):
    return N.state_round_trip(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")))


@query("k03_last_rows", sql("supp", ", n as (select *, row_number() over (partition by panel_id, series order by ds desc) as n from d) select panel_id, series, ds, value from n where n <= 12"))
def k03(spark, d):
    return C.last_rows(dense(spark, d, "supp"), 12)

