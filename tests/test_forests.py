"""Forests of windows against recursive doubles written here."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.kernels import forest as K
from panelcast.operators import autoregress as AR
from panelcast.operators import forests as FO
from panelcast.operators import linear as L

RNG = np.random.default_rng(11)


def one_tree(bins, y, w, order, tries, seed, tree, depth, least):
    """A tree by recursion: nested (feature, cut, left, right) or a value."""

    def node(rows, at, level):
        total = sum(w[i] for i in rows)
        mean = sum(w[i] * y[i] for i in rows) / total
        if level == depth:
            return mean
        subset = order[int(K.mix(seed, 4, tree, at) % np.uint64(K.TABLE))][:tries]
        best = None
        for f in subset:
            for cut in range(bins.max() + 1):
                left, right = [i for i in rows if bins[i, f] <= cut], [i for i in rows if bins[i, f] > cut]
                a, b = sum(w[i] for i in left), sum(w[i] for i in right)
                if a >= least and b >= least:
                    gain = sum(w[i] * y[i] for i in left) ** 2 / a + sum(w[i] * y[i] for i in right) ** 2 / b
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, cut, left, right)
        if best is None or best[0] <= total * mean**2 + 1e-9 * max(total * mean**2, 1e-12):
            return mean
        _, f, cut, left, right = best
        return f, cut, node(left, 2 * at + 1, level + 1), node(right, 2 * at + 2, level + 1)

    return node([i for i in range(len(y)) if w[i]], 0, 0)


def follow(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def doubles(bins, y, trees, seed, depth, least, tries):
    w, order = K.bags(trees, len(y), seed), K.orders(bins.shape[1], seed)
    return w, [one_tree(bins, y, w[t], order, tries, seed, t, depth, least) for t in range(trees)]


@pytest.mark.parametrize("tries", [2, 5])
def test_forest_equals_recursion(tries):
    x = RNG.integers(0, 40, (45, 5)).astype(float)
    y = (x[:, 0] > 17) * 32.0 + x[:, 2] * 2 + RNG.integers(0, 8, 45)
    bins = K.binned(x, 8)
    forest = K.grow(bins, y, 30, seed=3, depth=4, least=5, tries=tries, at_once=7)
    w, trees = doubles(bins, y, 30, 3, 4, 5, tries)
    assert (forest.weight == w).all() and 0.5 < (w > 0).mean() < 0.75
    want = np.array([[follow(t, row) for row in bins] for t in trees])
    assert np.allclose(forest.predictions(bins), want)
    unseen = [np.mean([want[t, i] for t in range(30) if not w[t, i]]) for i in range(45)]
    assert abs(forest.unseen_error(bins, y) - np.mean((y - unseen) ** 2)) < 1e-9


def test_importance_equals_its_definition():
    x = RNG.integers(0, 30, (40, 4)).astype(float)
    y = x[:, 1] * 3 + RNG.integers(0, 5, 40)
    bins = K.binned(x, 8)
    forest = K.grow(bins, y, 12, seed=5, depth=3)
    w, trees = doubles(bins, y, 12, 5, 3, 5, 1)
    want = []
    for f in range(4):
        rises = []
        for t, tree in enumerate(trees):
            out = sorted((i for i in range(40) if not w[t, i]), key=lambda i: (K.mix(5, 3, t, i) >> np.uint64(1), i))
            rise = 0.0
            for k, i in enumerate(out):
                row = bins[i].copy()
                row[f] = bins[out[(k + 1) % len(out)], f]
                rise += ((y[i] - follow(tree, row)) ** 2 - (y[i] - follow(tree, bins[i])) ** 2) / len(out)
            rises.append(rise)
        want.append(np.mean(rises) / np.std(rises, ddof=1) if np.std(rises) > 0 else 0.0)
    got = forest.importance(bins, y, 5)
    assert np.allclose(got, want) and got.argmax() == 1


def test_poisson_bags():
    w = K.bags(400, 300, 1)
    for k, p in enumerate(np.exp(-1) / np.array([1, 1, 2, 6, 24])):
        assert abs((w == k).mean() - p) < 0.005
    assert (K.bags(3, 300, 1) == w[:3]).all() and not (K.bags(3, 300, 2) == w[:3]).all()


def test_bins_know_no_later_rows():
    x = RNG.normal(size=(100, 3))
    later = x.copy()
    later[80:] += 100
    assert (K.binned(x, known=80)[:80] == K.binned(later, known=80)[:80]).all()
    small = K.binned(np.array([[3.0], [1.0], [3.0], [2.0]]))
    assert small[:, 0].tolist() == [2, 0, 2, 1]
    a = np.sort(x[:, 0])
    assert (np.diff(K.binned(a[:, None], 16)[:, 0]) >= 0).all() and len(np.unique(K.binned(a[:, None], 16))) == 16


def test_degenerate_windows():
    forest = K.grow(np.zeros((12, 2), np.int64), np.arange(12.0), 5)
    assert (forest.feature == -1).all() and forest.importance(np.zeros((12, 2), np.int64), np.arange(12.0), 7).tolist() == [0, 0]
    assert np.isfinite(K.grow(np.arange(3)[:, None], np.ones(3), 4).predict(np.arange(3)[:, None])).all()


def panel(spark, y, panels=("p",)):
    base = [float((i * 37) % 11 + i * 0.1) for i in range(60)]
    series = {"a_1": y} | {f"{n}_{k}": [v * (k + 1) + (i * (k + 3)) % (4 + k) for i, v in enumerate(base)] for k, n in enumerate(["b", "b", "c", "c"])}
    rows = [(p, n, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for p in panels for n, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "panel_id string, series string, ds date, value double").coalesce(1).persist()


def window(df, target, w, h, m, t=60):
    """x, y, history and the target's history of window ``w`` (from 1)."""
    wide = df.where("panel_id = 'p'").toPandas().pivot(index="ds", columns="series", values="value").sort_index()
    values, now = wide.to_numpy(float), t - m + w - 1 - h
    s = np.arange(w - 1, now - h + 1)
    y = values[:, list(wide.columns).index(target)]
    return values[s], y[s + h], values[w - 1 : now + 1], y[w - 1 : now + 1], list(wide.columns)


def test_window_forests_equal_a_loop(spark):
    df = panel(spark, [float((i * 29) % 13) for i in range(60)], ("p", "q"))
    h, m = 2, 5
    got = {(r.panel_id, r.target, r.window_id): r for r in L.forecast(df, L.work_list(df, None, [h], m), m, "random_forest", trees=8, lags=2, components=2).collect()}
    assert len(got) == 2 * 5 * m
    for w in (1, 4):
        for target in ("a_1", "c_3"):
            _, _, history, y, names = window(df, target, w, h, m)
            z = (history - history.mean(0)) / history.std(0, ddof=1)
            value, vectors = np.linalg.eigh(z.T @ z)
            top = vectors[:, ::-1][:, :2]
            top = top * np.sign(top[np.abs(top).argmax(0), [0, 1]])
            base = np.column_stack([z @ top * np.sqrt(len(names)) / len(names), history])
            x = np.column_stack([base[2:], base[1:-1], base[:-2]])
            bins, labels = K.binned(x, known=len(x) - 1), y[2 + h :]
            _, trees = doubles(bins[: len(labels)], labels, 8, w * 1000 + h * 31, 8, 5, x.shape[1] // 3)
            assert abs(got["p", target, w].y_pred - np.mean([follow(t, bins[-1]) for t in trees])) < 1e-6
            assert got["p", target, w].y_pred == got["q", target, w].y_pred


def test_selections_equal_a_loop(spark):
    df = panel(spark, [float((i * 29) % 13) for i in range(60)])
    h, m, base = 1, 3, lambda n: n.split("_")[0]
    work = L.work_list(df, None, [h], m)
    each = {(r.target, r.window_id, base(r.series)): r for r in FO.select_one_per_group(df, work, m, base, trees=6).collect()}
    turns = {(r.target, r.window_id, r.round): r for r in FO.select_recursive(df, work, m, base, trees=6).collect()}
    assert len(each) == len(turns) == 5 * m * 3
    for target in ("a_1", "b_0"):
        for w in (1, 3):
            x, y, _, _, names = window(df, target, w, h, m)
            bins = K.binned(x)

            def importance(at, k):
                return K.grow(bins[:, at], y, 6, w * 1000 + h * 31 + k).importance(bins[:, at], y, w * 1000 + h * 31 + k)  # noqa: B023

            left = {g: [j for j, n in enumerate(names) if base(n) == g] for g in ("a", "b", "c")}
            for k, g in enumerate(("a", "b", "c")):
                found = importance(left[g], k)
                assert each[target, w, g].series == names[left[g][found.argmax()]] and abs(each[target, w, g].coef - found.max()) < 1e-9
            for k in range(3):
                at = sorted(j for members in left.values() for j in members)
                best = names[at[importance(at, k).argmax()]]
                assert turns[target, w, k + 1].series == best
                del left[base(best)]


def test_preselected_forests_use_the_window_s_series(spark):
    df = panel(spark, [float(i % 7) for i in range(60)])
    rows = [("p", "a_1", 1, 1, "b_0"), ("p", "a_1", 1, 1, "c_2"), ("p", "a_1", 1, 3, "nothing"), ("p", "c_3", 1, 2, "c_3")]
    selection = spark.createDataFrame(rows, "panel_id string, target string, h int, window_id int, series string")
    got = {(r.target, r.window_id): r.y_pred for r in FO.preselected_forecast(df, selection, 5, trees=5, lags=1).collect()}
    assert got.keys() == {("a_1", 1), ("a_1", 3), ("c_3", 2)}
    for (target, w), series in {("a_1", 1): ["a_1", "b_0", "c_2"], ("a_1", 3): ["a_1"], ("c_3", 2): ["c_3"]}.items():
        alone = df.where(F.col("series").isin(series))
        work = L.work_list(alone, [target], [1], 5)
        want = {r.window_id: r.y_pred for r in L.forecast(alone, work, 5, "random_forest", trees=5, lags=1).collect()}
        assert got[target, w] == want[w]


def test_forests_do_not_look_ahead(spark):
    base = [float((i * 37) % 11 + i * 0.1) for i in range(60)]
    made = {}
    for key, y in (("a", base), ("b", base[:50] + [v + 1000 for v in base[50:]])):
        df = panel(spark, y)
        work = L.work_list(df, None, [3], 14)
        rows = L.forecast(df, work, 14, "random_forest", trees=3).collect()
        selection = spark.createDataFrame(FO.select_one_per_group(df, work, 14, lambda n: n[0], 3).toPandas()[["panel_id", "target", "h", "window_id", "series"]])
        rows += [r for r in FO.preselected_forecast(df, selection, 14, trees=3).collect()]
        made[key] = {(r.model, r.target, r.target_ds): r.y_pred for r in rows if r.origin_ds < dt.date(2004, 3, 1)}
    assert len(made["a"]) > 20 and made["a"] == made["b"]


@pytest.mark.parametrize("iterated", [False, True])
def test_autoregressions_from_moments_equal_the_kernel(spark, iterated):
    y = [1e4 + float((i * 29) % 13) + 3 * np.sin(i / 2) for i in range(60)]
    df = panel(spark, y, ("p", "q")).where("panel_id = 'p' or series <> 'c_3' or ds < date'2004-06-01'")
    holes = df.where("panel_id = 'q' and series = 'b_0'").withColumn("series", F.lit("gap")).withColumn("value", F.when(F.col("ds") != F.lit("2001-03-01"), F.col("value")))
    for ic, m in (("bic", 7), ("aic", 30)):
        got = {(r.panel_id, r.target, r.h, r.window_id): r for r in AR.ar_forecasts(df.unionByName(holes), [1, 3], m, 4, ic, iterated).collect()}
        alone = df.unionByName(df.where("series = 'c_3' and panel_id = 'q'").withColumn("panel_id", F.lit("alone"))).where("series <> 'c_3' or panel_id <> 'q'")
        want = L.forecast(alone, L.work_list(alone, None, [1, 3], m), m, "arp_iterated" if iterated else "arp_direct", most=4, ic=ic).collect()
        assert len(got) == len(want) > 0
        for w in want:
            r = got["q" if w.panel_id == "alone" else w.panel_id, w.target, w.h, w.window_id]
            assert (r.origin_ds, r.target_ds, r.y_true) == (w.origin_ds, w.target_ds, w.y_true)
            assert abs(r.y_pred - w.y_pred) < 1e-5 and abs(r.in_sample - w.in_sample) < 1e-5 and abs(r.err - w.err) < 1e-5


def test_units_have_tasks_of_their_own(spark):
    """Groups small in bytes aren't merged into one task."""
    df = panel(spark, [float(i % 7) for i in range(60)], [f"p{i}" for i in range(8)])
    rows = L.forecast(df, L.work_list(df, None, [1], 12), 12, "arp_direct")
    sizes = rows.rdd.glom().map(len).collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and sum(s > 0 for s in sizes) > spark.sparkContext.defaultParallelism
