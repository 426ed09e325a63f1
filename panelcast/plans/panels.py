"""Panels made from the sales and event tables, in the long form ``obs(panel_id, series, ds, value)``.

Money is summed as decimals, so totals don't depend on the order of rows.  ``SQL`` has the
same panels for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import KEYS, transform
from ..operators.calendar import carry_forward, densify, drop_first, drop_incomplete
from ..sources.io import cut

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _monthly(rows: DataFrame, panel: Column, series: Column, date: str, amount: str) -> DataFrame:
    total = (F.sum(F.col(amount).cast(MONEY)).cast("double") / 1000).alias("value")
    key = [panel.alias("panel_id"), series.cast("string").alias("series"), F.trunc(date, "MM").alias("ds")]
    return rows.groupBy(*key).agg(total)


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``flag, brand, supp, part, order``: one panel each; ``region``: brands in each region; ``nation``: suppliers in each nation."""
    if name == "order":
        return _monthly(table(spark, sf_dir, "orders"), F.lit(name), F.col("o_orderpriority"), "o_orderdate", "o_totalprice")
    items, label = table(spark, sf_dir, "lineitem"), F.lit(name)
    if name in ("brand", "region"):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        items = items.join(part, items.l_partkey == part.p_partkey)
    if name in ("region", "nation"):
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        items = items.join(supplier, items.l_suppkey == supplier.s_suppkey)
        label = F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"))
    if name == "region":
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        items = items.join(nation, items.s_nationkey == nation.n_nationkey)
        label = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"))
    series = {
        "supp": F.col("l_suppkey"), "nation": F.col("l_suppkey"), "part": F.col("l_partkey"), "flag": F.concat("l_returnflag", "l_linestatus"),
    }
    return _monthly(items, label, series.get(name, F.col("p_brand") if "p_brand" in items.columns else None), "l_shipdate", "l_extendedprice")


def dense(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return densify(panel(spark, sf_dir, name))


def growth(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Logarithmic differences of a panel's complete series; gaps take the last value, so no row knows a later one.

    The panel's monthly sums are a stored table, so facts are read once, however often the rows are used.
    """
    rows = cut(panel(spark, sf_dir, name), "panel")
    obs = carry_forward(densify(rows)).select(*KEYS, "ds", transform(5).alias("value"))
    return drop_incomplete(drop_first(obs, 1))


def gappy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Logarithmic differences of a panel on its calendar; gaps and unequal starts and ends stay."""
    return drop_first(dense(spark, sf_dir, name).select(*KEYS, "ds", transform(5).alias("value")), 1)


#: ``growth`` of the panel ``name`` as the CTE ``g5``
def growth_sql(name: str, body: str) -> str:
    return sql(name, f""", c5 as (select panel_id, series, ds, last_value(value ignore nulls) over (partition by panel_id, series order by ds rows unbounded preceding) as value from d),
l5 as (select panel_id, series, ds, row_number() over w as n5, case when min(value) over a > 1e-6 then ln(value) - ln(lag(value) over w) end as value
  from c5 window w as (partition by panel_id, series order by ds), a as (partition by panel_id, series)),
k5 as (select panel_id, series from l5 where n5 > 1 group by all having count(value) = count(*)),
g5 as materialized (select l5.panel_id, l5.series, l5.ds, l5.value from l5 join k5 using (panel_id, series) where n5 > 1)
{body}""")


_SERIES = {
    "supp": ("l_suppkey", "lineitem"),
    "part": ("l_partkey", "lineitem"),
    "flag": ("l_returnflag || l_linestatus", "lineitem"),
    "brand": ("p_brand", "lineitem join part on l_partkey = p_partkey"),
    "region": ("p_brand", "lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"),
    "nation": ("l_suppkey", "lineitem join supplier on l_suppkey = s_suppkey"),
}
_PANELS = {"region": "'region' || n_regionkey", "nation": "'nation' || s_nationkey"}


def sql(name: str, body: str, recursive: bool = True) -> str:
    """``body`` over the CTEs ``p`` (rows of the panel) and ``d`` (densified)."""
    if name == "order":
        series, source, date, amount = "o_orderpriority", "orders", "o_orderdate", "o_totalprice"
    else:
        (series, source), date, amount = _SERIES[name], "l_shipdate", "l_extendedprice"
    return f"""with {"recursive " if recursive else ""}p as materialized (
  select {_PANELS.get(name, f"'{name}'")} as panel_id, ({series})::varchar as series, date_trunc('month', {date})::date as ds,
         sum({amount}::decimal(18,2))::double / 1000 as value
  from {source} group by all),
g as (
  select panel_id, series, unnest(generate_series(min(ds), max(ds), interval 1 month))::date as ds
  from p group by panel_id, series),
d as materialized (select g.panel_id, g.series, g.ds, p.value from g left join p using (panel_id, series, ds))
{body}"""


#: recessions used with the monthly panels: three intervals, two of which overlap once widened
RECESSIONS = (("1996-02-01", "1996-06-01"), ("1996-09-01", "1996-11-01"), ("1999-05-01", "1999-10-01"))


def recessions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(RECESSIONS), "start string, end string")
    return rows.select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))


RECESSIONS_SQL = "(values " + ", ".join(f"(date '{a}', date '{b}')" for a, b in RECESSIONS) + ") r(a, b)"
