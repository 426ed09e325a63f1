"""Stored grids, searches, pooled models, vintages of many files, interval joins."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import calendar as C
from panelcast.operators import features as X
from panelcast.operators import linear as L
from panelcast.operators import trees as TR
from panelcast.plans import grid as G
from panelcast.sources import io
from tests.test_forests import panel


def test_a_stopped_grid_is_continued_without_repeats(spark, tmp_path, monkeypatch):
    df, path = panel(spark, [float(i % 7) for i in range(60)], ("p", "q", "r")), f"file://{tmp_path}/grid"
    ran, run = [], G.run_models

    def watched(obs, targets, horizons, models, *rest):
        ran.append((G.label(models[0]), horizons[0]))
        return run(obs, targets, horizons, models, *rest)

    monkeypatch.setattr(G, "run_models", watched)
    stop = [True]

    def stops(x, y, now, info):
        if stop[0] and info["h"] == 3:
            raise ValueError("executor lost")
        return float(y.mean()), None, {}

    args = (df, None, [1, 3])
    with pytest.raises(Exception, match="executor lost"):
        G.stored_models(*args, ["arp_direct", stops], 3, path, slices=2)
    before = G.finished(spark, path)
    assert {u[:2] for u in before} == {("arp_direct", 1), ("arp_direct", 3), ("stops", 1)} and len(ran) == 7
    # rows of a unit that never reached the manifest are not read and don't count twice
    spark.range(3).write.mode("overwrite").parquet(G._unit(path, "stops", 3, 0))
    ran.clear()
    stop[0] = False

    def stops(x, y, now, info):  # noqa: F811  the function that was lost, mended
        return float(y.mean()), None, {}

    got = G.stored_models(*args, ["arp_direct", stops], 3, path, slices=2)
    assert set(ran) == {("stops", 3)} and len(ran) == 2
    want = run(df, None, [1, 3], ["arp_direct", stops], 3)
    rows = lambda d: sorted(map(str, d.select(*G.COLUMNS).collect()))
    assert rows(got) == rows(want) and got.count() == 3 * 5 * 2 * 2 * 3
    ran.clear()
    assert rows(G.stored_models(*args, ["arp_direct", stops], 3, path, slices=2)) == rows(want) and not ran


def test_a_stored_grid_makes_its_panel_table_once(spark, tmp_path, monkeypatch):
    """Six units of two models read what the first step stored; columns beside the value stay, as they are features of pooled models."""
    df, path, made = panel(spark, [float(i % 7) for i in range(60)], ("p", "q", "r")), f"file://{tmp_path}/grid", spark.sparkContext.accumulator(0)
    seen, run = [], G.run_models
    monkeypatch.setattr(G, "run_models", lambda obs, *rest: (seen.append(obs.columns), run(obs, *rest))[1])

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(other=1.0)

    obs = df.mapInPandas(counted, "panel_id string, series string, ds date, value double, other double")
    args = (obs, None, [1], ["arp_direct", "ridge"], 3, path, 3)
    rows = lambda d: sorted(map(str, d.select(*G.COLUMNS).collect()))
    assert rows(G.stored_models(*args)) == rows(run(df, None, [1], ["arp_direct", "ridge"], 3))
    assert made.value == df.count() and seen == [obs.columns] * 6
    assert G.stored_models(*args).count() == 3 * 5 * 2 * 3 and made.value == df.count()  # nothing is left to do, so nothing is made


def test_pooled_models_are_added_by_name(spark):
    df = panel(spark, [float(i % 7) for i in range(60)])

    class Mean:
        def __init__(self, rows):
            self.mean = rows.agg(F.avg("y")).first()[0]

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(self.mean))

    TR.pooled("pooled_mean")(lambda rows: Mean(rows))
    try:
        got = G.run_models(df, None, [1], ["pooled_mean", "arp_direct"], 4, refit=2)
        assert {(r.model, r.n) for r in got.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()} == {("pooled_mean", 20), ("arp_direct", 20)}
        assert got.where("model = 'pooled_mean'").select("y_pred").distinct().count() == 2  # one fit for two dates
    finally:
        del TR.POOLED["pooled_mean"]


def test_search_scores_any_model_once(spark, tmp_path, monkeypatch):
    df, ledger = panel(spark, [float((i * 29) % 13) for i in range(60)]), f"file://{tmp_path}/ledger"
    tries = [{"model": "lasso", "ic": "bic"}, {"model": "ridge", "lam": 5.0}, {"model": "arp_direct", "most": 2}, {"model": "random_forest", "trees": 3, "lags": 1}]
    name = lambda c: json.dumps(c, sort_keys=True)
    first = L.search_models(df, ["a_1", "b_0"], [2], tries[:2], 3, ledger).collect()
    assert len(first) == 4 and all(r.n == 3 for r in first)
    both = L.search_models(df, None, [2], tries + tries[:1], 3, ledger).collect()
    assert len(both) == 5 * 4 and sum(r.best for r in both) == 5
    stored = spark.read.parquet(ledger)
    assert stored.count() == 20 == stored.select("target", "candidate").distinct().count()
    assert {str(r[:6]) for r in first} <= {str(r[:6]) for r in both}
    wide = df.toPandas().pivot(index="ds", columns="series", values="value").sort_index()
    values, j = wide.to_numpy(float), list(wide.columns).index("b_0")
    errors = []
    for target in range(57, 60):
        now = target - 2
        x, y = values[: now - 1], values[2 : now + 1, j]
        z, sd = (x - x.mean(0)), x.std(0, ddof=1)
        b = np.linalg.solve((z / sd).T @ (z / sd) + 5.0 * np.eye(5), (z / sd).T @ (y - y.mean()))
        errors.append(values[target, j] - y.mean() - (values[now] - x.mean(0)) / sd @ b)
    [r] = [r for r in both if r.target == "b_0" and r.candidate == name(tries[1])]
    assert abs(r.score - np.mean(np.square(errors))) < 1e-8
    for t in {r.target for r in both}:
        own = [r for r in both if r.target == t]
        assert [r.candidate for r in own if r.best] == [min(own, key=lambda r: (r.score, r.candidate)).candidate]


def test_vintages_have_their_own_columns(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "2020-01.csv").write_text("﻿sasdate,A,B & C,\nTransform:,1,5,\n2000-01-01,1.5,,9\n2000-02-01,x,3\n\n")
    (tmp_path / "v" / "2020-02.csv").write_text("sasdate,D,A\r\nTransform:,2,7\r\n2000-01-01,4,5,6\r\n")
    (tmp_path / "v" / "empty.csv").write_text("")
    (tmp_path / "v" / "head.csv").write_text("sasdate,A\n")
    obs, meta = io.read_vintages(spark, f"file://{tmp_path}/v")
    day = lambda m: dt.date(2000, m, 1)
    got = {(r.panel_id, r.series, r.ds): r.value for r in obs.collect()}
    assert got == {
        ("2020-01", "A", day(1)): 1.5, ("2020-01", "BC", day(1)): None, ("2020-01", "A", day(2)): None, ("2020-01", "BC", day(2)): 3.0,
        ("2020-02", "D", day(1)): 4.0, ("2020-02", "A", day(1)): 5.0,
    }
    assert {tuple(r) for r in meta.collect()} == {("2020-01", "A", 1), ("2020-01", "BC", 5), ("2020-02", "D", 2), ("2020-02", "A", 7)}


@pytest.mark.parametrize("width", [1.0, 60.0, 100_000.0])
def test_interval_join_by_brute_force(spark, width):
    rng, base = np.random.default_rng(4), dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=float(s))
    points = [(int(k), at(s)) for k, s in zip(rng.integers(0, 3, 80), rng.uniform(-5, 600, 80))] + [(0, at(10)), (0, at(20.5)), (0, at(20.5)), (1, None), (None, at(5))]
    spans = [(int(k), at(s), at(s + n)) for k, s, n in zip(rng.integers(0, 3, 20), rng.uniform(0, 500, 20), rng.uniform(0, 200, 20))]
    spans += [(0, at(10), at(20.5)), (0, at(10), at(10)), (0, at(50), at(40)), (1, None, at(9)), (1, at(3), None), (None, at(0), at(9))]
    p, i = spark.createDataFrame(points, "k int, ts timestamp"), spark.createDataFrame(spans, "k int, start timestamp, end timestamp")
    got = sorted(str((r.k, r.ts, r.n_intervals, r.crisis)) for r in C.interval_flag(p, i, ["k"], "ts", width).collect())
    n = lambda k, t: sum(k is not None and t is not None and None not in (a, b) and k == q and a <= t <= b for q, a, b in spans)
    assert got == sorted(str((k, t, n(k, t), int(n(k, t) > 0))) for k, t in points)
    assert C.interval_flag(p, i.limit(0), ["k"], "ts", width).where("crisis = 1").count() == 0


def test_window_scaling_by_its_rows(spark):
    y = [1e6 + float((i * 29) % 13) if i % 9 else None for i in range(30)]
    rows = [("p", s, dt.date(2000 + i // 12, i % 12 + 1, 1), v) for s, vs in {"a": y, "short": y[:4], "flat": [5.0] * 30}.items() for i, v in enumerate(vs)]
    got = {(r.series, r.window_id): r for r in X.window_scaling(spark.createDataFrame(rows, "panel_id string, series string, ds date, value double"), 6, 2).collect()}
    assert set(got) == {(s, w) for s in ("a", "flat") for w in range(1, 7)}
    for w in range(1, 7):
        own = [v for v in y[w - 1 : 30 - 6 + w - 2] if v is not None]
        r = got["a", w]
        assert r.n == len(own) and abs(r.mean - np.mean(own)) < 1e-6 and abs(r.sd - np.std(own, ddof=1)) < 1e-6
        last = y[30 - 6 + w - 2 - 1]
        assert r.z is None if last is None else abs(r.z - (last - np.mean(own)) / np.std(own, ddof=1)) < 1e-6
        assert (got["flat", w].mean, got["flat", w].sd, got["flat", w].z) == (5.0, 0.0, None)


def test_interval_ends_at_halves_are_those_of_the_sql(spark, tmp_path):
    """904.5 seconds are 904 in SQL's cast, and 905.4999997 are 905: an event in the second after is outside."""
    import duckdb

    from panelcast.queries.all_queries import QUERIES, SQL

    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 1, "error", 0.05), (2, at, 2, "error", 5.4999997 / 90), (3, at, 3, "error", 5.5 / 90)]
    rows += [(10 * u + k, at + dt.timedelta(seconds=s), u, "view", 1.0) for u in (1, 2, 3) for k, s in enumerate((903.9, 904.0, 904.4, 905.0, 905.6, 906.0, 906.1))]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    con.executemany("insert into events values (?, ?, ?, ?, ?)", rows)
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["j04_interval_flag"](spark, f"file://{tmp_path}").select("event_id", "n_intervals", "crisis")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"select event_id, n_intervals, crisis from ({SQL['j04_interval_flag']})").fetchall())
