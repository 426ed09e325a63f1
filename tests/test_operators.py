"""Hand-made cases: edges, gaps, names, look-ahead, files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import names as N
from panelcast.functions import transforms as T
from panelcast.operators import calendar as C
from panelcast.kernels import factors as KF
from panelcast.kernels import inference as KI
from panelcast.operators import evaluate as E
from panelcast.operators import factors as FA
from panelcast.operators import features as X
from panelcast.operators import linear as L
from panelcast.operators import stationary as ST
from panelcast.operators import trees as TR
from panelcast.operators.select import selection_codes
from panelcast.plans.grid import run_models
from panelcast.sources import io


def obs(spark, values, series="a", start=(2000, 1)):
    rows = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i
        rows.append(("p", series, dt.date(start[0] + m // 12, m % 12 + 1, 1), None if v is None else float(v)))
    return spark.createDataFrame(rows, "panel_id string, series string, ds date, value double")


def values(df, col="value"):
    return [r[col] for r in df.orderBy("ds").collect()]


def test_densify_puts_gaps_as_null(spark):
    df = obs(spark, [1, 2, 3, 4]).where("ds <> (date'2000-02-01')")
    assert values(C.densify(df)) == [1, None, 3, 4]


def test_log_transforms_need_positive_series(spark):
    for code in (4, 5, 6):
        assert set(values(obs(spark, [1, -1, 2]).select("ds", T.transform(code).alias("value")))) == {None}
    assert values(obs(spark, [1, 2, 4]).select("ds", T.transform(7).alias("value")))[2] == 0.0
    assert values(obs(spark, [0, 2, 4]).select("ds", T.transform(7).alias("value")))[2] is None


def test_detrended_counts_from_the_first_value(spark):
    got = values(T.detrended(obs(spark, [None, *range(14)]), "value", "y"), "y")
    assert got[1:13] == list(range(12)) and got[13] == 12 - 5.5 and got[0] is None


def test_box_cox_prefers_the_log_for_exponentials(spark):
    import math

    df = obs(spark, [math.exp(0.1 * (i % 7) + 0.01 * i) for i in range(60)])
    assert abs(T.box_cox(df).first().lam) <= 2


def test_ma_fill_pads_edges(spark):
    got = values(C.ma_fill(obs(spark, [None, 1, 1, 1, 1, 1, None])), "filled")
    assert got == [1.0] * 7


def test_outliers(spark):
    df = obs(spark, [1, 2, 3, 4, 100])
    assert values(C.flag_outliers(df, 3), "is_outlier") == [False] * 4 + [True]


def test_date_round_trip(spark):
    df = spark.createDataFrame([(1959 + 1 / 12, "1959-01-01"), (1960.0, "1959-12-01"), (2000.5, "2000-06-01")], "d double, want string")
    assert all(str(r.got) == r.want for r in df.withColumn("got", C.decimal_to_date(F.col("d"))).collect())


def test_unknown_target_is_an_error(spark):
    known = spark.createDataFrame([("A", "A_lvl")], "base string, name string")
    assert N.resolve_targets(known, ["all"]).count() == 1
    with pytest.raises(ValueError, match="B"):
        N.resolve_targets(known, ["A", "B"])


def test_double_errors_are_refused(spark):
    e = E.simple_errors(obs(spark, range(30)), (1,), 3)
    truth = obs(spark, range(30)).select("panel_id", F.col("series").alias("target"), "ds", F.col("value").alias("truth"))
    assert len(E.errors_to_predictions(e, truth).collect()) == 9
    with pytest.raises(Exception, match="more than one error"):
        E.errors_to_predictions(e.union(e), truth).collect()


def test_no_forecast_looks_ahead(spark):
    """Changing the future never changes an earlier forecast."""
    base = [float((i * 37) % 11 + i * 0.1) for i in range(60)]
    later = base[:50] + [v + 1000 for v in base[50:]]
    made = {}
    for key, y in (("a", base), ("b", later)):
        df = obs(spark, y).union(obs(spark, [v * 2 + (i % 5) for i, v in enumerate(base)], "x"))
        work = L.work_list(df, ["a"], [3], 12)
        rows = [r for model in ("arp_direct", "arp_iterated", "lasso", "ridge", "adaptive_lasso", "ar_factor", "ar_factor_iterated", "state") for r in L.forecast(df, work, 12, model, **({"ic": "bic"} if model == "lasso" else {})).collect()]
        rows += E.simple_errors(df, (3,), 12).where("target = 'a'").withColumnsRenamed({"ds": "target_ds"}).withColumn("origin_ds", F.add_months("target_ds", -3)).collect()
        made[key] = {(r.model, r.target_ds): r.y_pred for r in rows if r.origin_ds < dt.date(2004, 3, 1)}
    assert len(made["a"]) > 10 and made["a"] == made["b"]


def panel_of(spark, y):
    base = [float((i * 37) % 11 + i * 0.1) for i in range(60)]
    series = {"a": y} | {name: [v * (k + 1) + (i % (3 + k)) for i, v in enumerate(base)] for k, name in enumerate("wxz")}
    rows = [("p", n, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for n, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "panel_id string, series string, ds date, value double").coalesce(1).persist()


def test_no_forest_looks_ahead(spark):
    """Changing the last ten rows of a series changes no forecast made before them, selections and factors included."""
    base = [float((i * 37) % 11 + i * 0.1) for i in range(60)]
    made = {}
    for key, y in (("a", base), ("b", base[:50] + [v + 1000 for v in base[50:]])):
        df = panel_of(spark, y)
        rows = []
        for kind, r in (("forest", 2), ("boosted", 0)):
            rows += TR.tree_forecast(df, 3, 14, kind, 2, refit=7, r=r).collect()
        made[key] = {(r.model, r.target, r.target_ds): r.y_pred for r in rows if r.origin_ds < dt.date(2004, 3, 1)}
    # a fit serves several origins, so those of one fit with its first origin before the change are alike
    assert len({k[0] for k in made["a"]}) == 2 and made["a"].keys() == made["b"].keys()
    assert {k for k in made["a"] if k[1] != "a"} and made["a"] == made["b"]


def test_finished_tree_work_is_not_done_again(spark):
    df = panel_of(spark, [float(i % 7) for i in range(60)])
    keys = df.select("panel_id", F.col("series").alias("target")).distinct()
    done = keys.withColumns({"h": F.lit(1), "model": F.lit("forest")}).union(keys.where("target = 'a'").withColumns({"h": F.lit(3), "model": F.lit("forest")}))
    got = run_models(df, None, [1, 3], ["forest", "arp_direct"], 3, done, 2).groupBy("model", "target", "h").count().collect()
    assert {(r.model, r.target, r.h) for r in got} == {("forest", t, 3) for t in "wxz"} | {("arp_direct", t, h) for t in "awxz" for h in (1, 3)}


def test_own_models_follow_the_protocol(spark):
    df = panel_of(spark, [float(i % 7) for i in range(60)])

    def mean_of_labels(x, y, now, info):
        return float(y.mean()), float(y.var()), {info["names"][0]: 1.0}

    rows = L.forecast(df, L.work_list(df, ["a"], [2], 3), 3, mean_of_labels).collect()
    assert len(rows) == 3 and {r.model for r in rows} == {"mean_of_labels"} and all(r.in_sample > 0 for r in rows)
    assert L.importances(df, L.work_list(df, ["a"], [2], 3), 3, mean_of_labels).count() == 3


def test_loadings_and_factors_match_one_matrix(spark):
    df = panel_of(spark, [float((i * 13) % 7) for i in range(60)]).unionByName(panel_of(spark, [float(i % 5) for i in range(60)]).withColumn("panel_id", F.lit("q")))
    df = df.unionByName(df.where("series = 'w' and ds > (date'2001-01-01')").withColumn("series", F.lit("short")))
    got = {(r.panel_id, r.series, r.factor): r.loading for r in FA.loadings(df, 2).collect()}
    values_ = {(r.panel_id, r.ds, r.factor): r.value for r in FA.factors(df, 2).collect()}
    for p, pdf in df.where("series <> 'short'").toPandas().groupby("panel_id"):
        wide = pdf.pivot(index="ds", columns="series", values="value").sort_index()
        x = wide.to_numpy(float)
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        load, f, _ = KF.static_factors(z, 2)
        assert np.allclose([[got[p, n, k + 1] for k in range(2)] for n in wide.columns], load)
        assert np.allclose([[values_[p, d, k + 1] for k in range(2)] for d in wide.index], f)
    assert not any(k[1] == "short" for k in got)


def test_confidence_set_of_units_of_unequal_length(spark):
    rng, rows = np.random.default_rng(2), []
    for unit, t in (("u", 40), ("v", 13)):
        for i in range(t):
            for model, scale in (("good", 0.3), ("bad", 3.0), ("fine", 0.31)):
                rows.append(("p", model, unit, 1, dt.date(2000 + i // 12, i % 12 + 1, 1), float(rng.normal() * scale)))
    rows.append(("p", "good", "v", 1, dt.date(2010, 1, 1), 99.0))  # a date that lacks the other models
    errors = spark.createDataFrame(rows, "panel_id string, model string, target string, h int, ds date, err double")
    got = {(r.target, r.model): r for r in ST.confidence_set(errors, draws=50, width=3).collect()}
    for unit, t in (("u", 40), ("v", 13)):
        index = E.bootstrap_index(spark, t, 50, 3, "stationary").toPandas().sort_values(["b", "t"])["i"].to_numpy().reshape(50, t)
        names = sorted({"good", "bad", "fine"})
        loss = np.array([[r[5] ** 2 for r in sorted(rows, key=lambda r: r[4]) if r[2] == unit and r[1] == m and r[4].year < 2010] for m in names]).T
        order, p = KI.confidence_set(loss.mean(0), loss[index].mean(axis=1))
        for k, (i, q) in enumerate(zip(order, p)):
            assert got[unit, names[i]].place == k + 1 and abs(got[unit, names[i]].p - q) < 1e-9
    assert not got["u", "bad"].kept


def test_windows_without_a_selection_count_as_none(spark):
    windows = spark.createDataFrame([("t", 1), ("t", 2), ("s", 1)], "target string, window_id int")
    chosen = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("s", 1, "a"), ("s", 1, "b")], "target string, window_id int, series string")
    assert [(r.target, r.least) for r in E.min_selected(chosen, windows).collect()] == [("t", 0)]


def test_selection_codes_belong_to_panels(spark):
    chosen = spark.createDataFrame([("p", 1, "a", "dif_log"), ("p", 1, "a", "lvl"), ("q", 2, "b", "box")], "panel_id string, window_id int, base string, transform string")
    bases = spark.createDataFrame([("p", "a"), ("p", "c"), ("q", "b"), ("q", "b")], "panel_id string, base string")
    assert sorted(tuple(r) for r in selection_codes(chosen, bases).collect()) == [("p", 1, "a", 1), ("p", 1, "c", 0), ("q", 2, "b", 12)]


def test_codes_belong_to_panels(spark):
    two = obs(spark, [1, 2, 4]).union(obs(spark, [1, 2, 4]).withColumn("panel_id", F.lit("q")))
    meta = spark.createDataFrame([("p", "a", 1), ("q", "a", 2)], "panel_id string, series string, tcode int")
    got = {(r.panel_id, str(r.ds)): r.value for r in T.apply_tcode(two, meta).collect()}
    assert len(got) == 6 and got["p", "2000-03-01"] == 4 and got["q", "2000-03-01"] == 2


def test_matrices_of_several_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("\ufeff1;2\n\n3;4\n")
    (tmp_path / "part-1.csv").write_text("".join(f"{i};x\n" for i in range(5, 400)))
    got = io.read_matrix(spark, f"file://{tmp_path}").where("col = 1").orderBy("row").collect()
    assert [r.row for r in got] == list(range(1, 398)) and [r.value for r in got] == [1.0, 3.0, *map(float, range(5, 400))]


def test_gap_modes(spark):
    y = [None, None, 1.0, None, 4.0, 9.0, 16.0, None, None]
    df = obs(spark, y).union(obs(spark, [None, *range(1, 8), None], "b"))
    filled = {m: X.fill_gaps(df, m).where("series = 'a'").orderBy("ds").collect() for m in range(1, 6)}
    assert [len(filled[m]) for m in range(1, 6)] == [9, 7, 7, 7, 9]
    assert [r.filled for r in filled[3]] == [None, 1, None, 4, 9, 16, None]
    assert abs(filled[4][2].filled - 2.0) < 1.5 and all(r.filled is not None for m in (1, 2, 4, 5) for r in filled[m])


def test_search_finds_the_best_candidate(spark):
    y = [np.sin(i / 3) * 5 + (i * 7919 % 13) / 50 for i in range(80)]
    tries = L.random_candidates(6) + [{"lags": 3, "lambda": 0.01}] * 2
    assert L.random_candidates(6) == L.random_candidates(6) and all(1 <= c["lags"] <= 12 and 1e-3 <= c["lambda"] <= 1e3 for c in tries)
    best = L.hyperparameter_search(obs(spark, y), None, 1, tries).collect()
    def score(p, lam):
        x, v = np.array([[y[t - k] for k in range(p)] for t in range(p - 1, 79)]), np.array(y[p:])
        size, out = len(v) // 6, []
        for k in range(5):
            cut = len(v) - (5 - k) * size
            mean, sd = x[:cut].mean(0), x[:cut].std(0, ddof=1)
            z, m = (x[:cut] - mean) / sd, v[:cut].mean()
            b = np.linalg.solve(z.T @ z + lam * np.eye(p), z.T @ (v[:cut] - m))
            out.append(((v[cut : cut + size] - m - (x[cut : cut + size] - mean) / sd @ b) ** 2).mean())
        return np.mean(out)
    scores = {(c["lags"], c["lambda"]): score(c["lags"], c["lambda"]) for c in tries}
    assert len(best) == 1 and (best[0].lags, best[0]["lambda"]) == min(scores, key=scores.get) and abs(best[0].score - min(scores.values())) < 1e-8


def test_one_series_of_each_group_is_selected(spark):
    df = panel_of(spark, [float((i * 31) % 17) for i in range(60)])
    got = L.select_one_per_group(df, L.work_list(df, ["a"], [1], 2), 2, lambda n: "one" if n in "aw" else "two").collect()
    assert len(got) == 4 and all(len({r.series for r in got if r.window_id == w}) == 2 for w in (1, 2))


def test_error_files(spark, tmp_path):
    cols = "filename string, model_name string, start int, horizon string, target_var string, model_label string, date date, crisis string, values double"
    rows = spark.createDataFrame([("f", "m", 1, "h1", "T", "l", dt.date(2000, 1, 1), "crisis", 0.5)], cols)
    path = f"file://{tmp_path}/errors"
    io.write_errors(rows, path)
    with pytest.raises(Exception, match="exist"):
        io.write_errors(rows, path)
    io.write_errors(rows, path, append=True)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        io.write_errors(rows.drop("crisis"), path, append=True)


def test_blank_cells_of_a_vintage_are_null(spark, tmp_path):
    (tmp_path / "v.csv").write_text("sasdate,RPI & x,M1\nTransform:,5,6\n2000-01-01,1.5,\n2000-02-01, ,2\n")
    data, meta = io.read_vintage(spark, f"file://{tmp_path}/v.csv")
    assert {(r.series, str(r.ds), r.value) for r in data.collect()} == {("RPIx", "2000-01-01", 1.5), ("RPIx", "2000-02-01", None), ("M1", "2000-01-01", None), ("M1", "2000-02-01", 2.0)}
    assert {(r.panel_id, r.series, r.tcode) for r in meta.collect()} == {("vintage", "RPIx", 5), ("vintage", "M1", 6)}


def test_splines_do_not_depend_on_batches(spark):
    """Series longer than an Arrow batch, many in a batch, and one without a name."""
    from panelcast.kernels.spline import spline_fill_values

    rng = np.random.default_rng(3)
    made = {("p" if i % 2 else "q", f"s{i}" if i else None): np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)) for i, n in enumerate((6, 40, 3, 7, 7, 14, 1, 5, 8))}
    rows = [(p, s, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for (p, s), y in made.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "panel_id string, series string, ds date, value double").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = X.spline_fill(df).orderBy("panel_id", "series", "ds").collect()
            assert len(got) == len(rows)
            for (p, s), y in made.items():
                filled = [r.filled for r in got if (r.panel_id, r.series) == (p, s)]
                assert np.allclose([np.nan if v is None else v for v in filled], spline_fill_values(y), equal_nan=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
