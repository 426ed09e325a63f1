"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from panelcast.plans.panels import panel
from panelcast.queries.all_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    cur = duck.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert len(cols) == len(cur.description) and got == want


def frame(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


FORECASTS = ["m02_arp_direct", "m02b_arp_iterated", "m04_lasso", "m05_ridge", "m06_adaptive_lasso", "m07_random_forest_full_size", "m08_preselected_forest", "m12_state_factors", "m13_stored_models"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", FORECASTS)
def test_forecasts_are_whole(spark, name):
    """One row a target, horizon and window, finite, with its error and an origin before its label."""
    df = frame(spark, name)
    key = ["panel_id", "model", "target", "h", "target_ds"]
    assert len(df) and not df.duplicated(key).any() and np.isfinite(df["y_pred"]).all()
    assert np.allclose(df["err"], df["y_true"] - df["y_pred"]) and (df["origin_ds"] < df["target_ds"]).all()
    scale = df.groupby(["panel_id", "target"])["y_true"].transform(lambda v: np.abs(v).max())
    assert ((df["y_pred"].abs() <= 5 * scale).mean() > 0.95) if "ar" in name or "forest" in name else True


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_selections_have_one_series_of_each_group(spark):
    for name in ("v02_select_one_per_group", "v03_select_one_per_group_rf", "v04_select_recursive_rf"):
        df = frame(spark, name)
        df["var_group"] = df["series"].str.slice(6).astype(int) % 5
        n = df.groupby(["panel_id", "target", "h", "window_id"])["var_group"].agg(["count", "nunique"])
        assert len(n) >= 24 and (n["count"] == n["nunique"]).all() and (n["nunique"] == 5).all(), name
    assert (frame(spark, "v04_select_recursive_rf").groupby(["target", "window_id"])["round"].agg(set) == {1, 2, 3, 4, 5}).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,source", [("f04_factor_fill", "nation"), ("f04_fill_by_rounds", "region")])
def test_fills_leave_no_gap_and_known_values_alone(spark, name, source):
    df = frame(spark, name).merge(panel(spark, DATA, source).toPandas(), on=["panel_id", "series", "ds"], how="left")
    known = df["value"].notna()
    assert np.isfinite(df["filled"]).all() and known.any() and np.allclose(df["filled"][known], df["value"][known])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["f02_factor_count", "t01_adf", "t06_model_confidence_set", "w23_spline_fill", "s07_write_errors", "s10_write_selection", "c05_search_models"])
def test_others_give_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["m05_ridge", "f04_factor_fill", "t06_model_confidence_set"])
def test_much_work_has_many_tasks(spark, name):
    """Groups of few bytes and much work aren't merged into a task or two."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,times", [("w23_fill_gaps", 4)])
def test_windows_over_dense_rows_have_many_tasks(spark, name, times):
    """Sorted series of few bytes aren't merged into a task or two, for each way to fill."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= times * 4 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["m05_ridge", "m13_run_models"])
def test_models_read_stored_sums(spark, name):
    """Every model and horizon uses the panel; none goes back to the facts."""
    assert not [f for f in QUERIES[name](spark, DATA).inputFiles() if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
