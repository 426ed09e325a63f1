"""Properties of the numeric kernels, against definitions or doubles written here."""

import numpy as np
import pytest

from panelcast.kernels import factors as KF
from panelcast.kernels import linear as KL
from panelcast.kernels.gram import Pairs, Run
from panelcast.kernels import inference as KT
from panelcast.kernels.spline import spline_fill_values

RNG = np.random.default_rng(0)


def standard(n=80, k=6):
    x = RNG.normal(size=(n, k))
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = x[:, 0] * 2 - x[:, 3] + RNG.normal(size=n)
    return x, y - y.mean()


@pytest.mark.parametrize("alpha", [1.0, 0.5])
def test_lasso_meets_its_conditions(alpha):
    x, y = standard()
    lambdas = KL.lambda_grid(x, y, alpha, 20)
    path = KL.lasso_path(x.T @ x / len(y), x.T @ y / len(y), lambdas, alpha)
    assert not path[0].any() or np.abs(path[0]).max() < 1e-8
    for lam, b in zip(lambdas, path):
        grad = x.T @ (y - x @ b) / len(y) - lam * (1 - alpha) * b
        on = b != 0
        assert np.allclose(grad[on], lam * alpha * np.sign(b[on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= lam * alpha + 1e-6).all()


def test_ridge_equals_normal_equations_and_enet_without_l1():
    x, y = standard()
    for lam, b in zip([0.1, 10.0], KL.ridge_path(x.T @ x, x.T @ y, np.array([0.1, 10.0]))):
        assert np.allclose(b, np.linalg.solve(x.T @ x + lam * np.eye(6), x.T @ y))
        e = KL.lasso_path(x.T @ x / 80, x.T @ y / 80, np.array([lam / 80]), alpha=0.0)[0]
        assert np.allclose(b, e, atol=1e-6)


def test_block_splits_leave_a_gap():
    n, h, ratio, size = 100, 3, 0.6, 6
    t = n + h  # dates
    train = int(ratio * t)
    count = (t - train - 2 * h) // size
    want = [(list(range(b * size, b * size + train)), list(range(b * size + train + h, t - h if b == count - 1 else (b + 1) * size + train + h))) for b in range(count)]
    got = [(list(range(n))[tr], list(range(n))[te]) for tr, te in KL.block_splits(n, h, ratio, size)]
    assert got == want and got[-1][1][-1] == n - 1
    assert all(tr[-1] + h < te[0] for tr, te in got)  # training labels are older than the first test row
    assert KL.block_splits(5, 3, 0.8, 6) == []


def test_lasso_paths_agree_with_coordinate_descent():
    for trial in range(12):
        x, y = standard(60, 12)
        if trial % 3 == 0:
            x[:, 5] = x[:, 2] + 0.1 * x[:, 5]  # nearly dependent
        g, c = x.T @ x / len(y), x.T @ y / len(y)
        lambdas = KL.lambda_grid(x, y, 1.0, 40)
        want = KL._descent(g, c, lambdas, 1.0, 20_000, 1e-13)
        got = KL._knots(g, c, lambdas)
        assert got is not None and np.allclose(got, want, atol=1e-6)
        for alpha in (0.5, 0.9):
            lambdas = KL.lambda_grid(x, y, alpha, 40)
            got = KL._active(g, c, lambdas, alpha)
            assert got is not None and np.allclose(got, KL._descent(g, c, lambdas, alpha, 20_000, 1e-13), atol=1e-6)
    double = np.column_stack([x, x[:, 0]])  # a column twice: still optimal
    path = KL.lasso_path(double.T @ double / 60, double.T @ y / 60, lambdas := KL.lambda_grid(double, y, 1.0, 20))
    grad = double.T @ (y[:, None] - double @ path.T) / 60
    assert (np.abs(grad) <= lambdas[None, :] + 1e-5).all()


def test_adaptive_validation_fits_weights_in_each_block():
    x, y = standard(90, 5)
    y = y + x @ np.array([0.0, 0.5, 0.0, 0.0, 0.2])
    lambdas, h = np.linspace(0.5, 0.001, 15), 2
    errors = []
    for tr, te in KL.block_splits(len(y), h, 0.7, 5):
        mean, sd, my = x[tr].mean(0), x[tr].std(0, ddof=1), y[tr].mean()
        z, v = (x[tr] - mean) / sd, y[tr] - my
        start = np.linspace(0.001, 500, 200)
        inner = []
        for tr2, te2 in KL.block_splits(len(v), h, 0.7, 5):
            m2, s2, y2 = x[tr][tr2].mean(0), x[tr][tr2].std(0, ddof=1), y[tr][tr2].mean()
            q = (x[tr][tr2] - m2) / s2
            b = np.array([np.linalg.solve(q.T @ q + lam * np.eye(5), q.T @ (y[tr][tr2] - y2)) for lam in start])
            inner.append(((y[tr][te2] - y2)[None] - b @ ((x[tr][te2] - m2) / s2).T) ** 2)
        lam = start[np.mean([e.mean(1) for e in inner], axis=0).argmin()]
        w = np.abs(np.linalg.solve(z.T @ z + lam * np.eye(5), z.T @ v)) + 1e-6
        b = KL._descent((z * w).T @ (z * w) / len(v), (z * w).T @ v / len(v), lambdas, 1.0, 5000, 1e-12) * w
        errors.append((((y[te] - my)[None] - b @ ((x[te] - mean) / sd).T) ** 2).mean(1))
    got = KL.block_cv("adaptive", x, y, lambdas, h)
    assert np.allclose(got, np.mean(errors, axis=0), rtol=1e-5)
    assert not np.allclose(got, KL.block_cv("lasso", x, y, lambdas, h))
    fit = KL.penalised(x, y, h, "adaptive", ic="cv", steps=30)
    assert fit["lambda"] == fit["lambdas"][KL.block_cv("adaptive", x, y, fit["lambdas"], h).argmin()]


def test_windows_of_prefix_sums_equal_their_rows():
    x, y = RNG.normal(size=(140, 4)) * [1, 5, 0.1, 2] + [100, -3, 0, 7], RNG.normal(size=(140, 3)) + 50
    for pairs in (Pairs(x, y), Pairs(x, y, most_numbers=0)):
        for a, b, j in ((0, 140, 0), (13, 90, 1), (40, 140, 2)):
            run = Run(pairs, a, b, j)
            mean, sd = KL.scale(x[a:b])
            z, v = (x[a:b] - mean) / sd, y[a:b, j] - y[a:b, j].mean()
            assert np.allclose(run.gram, z.T @ z, atol=1e-8) and np.allclose(run.xy, z.T @ v, atol=1e-8) and abs(run.yy - v @ v) < 1e-8
            for ic in ("bic", "aic", "cv", "grid"):
                for method in ("lasso", "ridge", "adaptive"):
                    one, other = KL.penalised(x[a:b], y[a:b, j], 1, method, ic=ic, steps=20), KL.penalised(None, None, 1, method, ic=ic, steps=20, run=run)
                    assert np.allclose(one["coef"], other["coef"], atol=1e-8) and one["idx"] == other["idx"]
                    assert abs(other["mse"] - ((y[a:b, j] - KL.predict(other, x[a:b])) ** 2).mean()) < 1e-8


def test_validation_errors_come_from_test_rows():
    x, y = standard(90, 5)
    lambdas = np.array([0.3, 0.05])
    errors = []
    for tr, te in KL.block_splits(len(y), 2, 0.7, 5):
        mean, sd = KL.scale(x[tr])
        z, v = (x[tr] - mean) / sd, y[tr] - y[tr].mean()
        b = KL._descent(z.T @ z / len(v), z.T @ v / len(v), lambdas, 1.0, 5000, 1e-12)
        errors.append([((y[te] - y[tr].mean() - (x[te] - mean) / sd @ c) ** 2).mean() for c in b])
    assert np.allclose(KL.block_cv("lasso", x, y, lambdas, 2), np.mean(errors, axis=0))


def test_adaptive_search_finds_a_smooth_minimum():
    score = lambda lam: (np.log(lam) - np.log(0.2)) ** 2
    for start in (5.0, 0.001, (0.1, 0.3, 9.0), (0.5, 0.6, 0.7)):
        assert abs(np.log(KL.adaptive_search(score, start) / 0.2)) < np.log(2)


def test_adaptive_search_goes_by_its_rules():
    tried = []

    def score(lam):
        tried.append(lam)
        return abs(lam - 10.0)

    best = KL.adaptive_search(score, (1.0, 2.0, 4.0), 4)
    # the greatest is best and better than just below it: up, up, up beyond the minimum, then the mean of the best two
    assert np.allclose(tried, [1, 2, 4, 3.8, 6, 9, 13.5, (9 + 13.5) / 2]) and best == 9.0
    tried.clear()
    KL.adaptive_search(score, (20.0, 40.0, 80.0), 2)
    assert np.allclose(tried, [20, 40, 80, 21, 10, 5])


def test_autoregressions_find_their_order_and_value():
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.6 * y[t - 1] + 0.3 * y[t - 2] + RNG.normal() * 0.1
    value, p, _, mse = KL.ar_iterated(y, 1)
    assert abs(mse - 0.01) < 0.003
    assert p == 2 and abs(value - (0.6 * y[-1] + 0.3 * y[-2])) < 0.05
    direct, q, _, _ = KL.ar_direct(y, 1)
    assert q == 2 and abs(direct - value) < 1e-6


def test_iterated_autoregression_with_factors():
    f, y = np.zeros((500, 1)), np.zeros(500)
    for t in range(1, 500):
        f[t] = 0.8 * f[t - 1] + RNG.normal()
        y[t] = 0.5 * y[t - 1] + 0.7 * f[t - 1, 0] + 0.1 * RNG.normal()
    value, p, m, _ = KL.ar_iterated(y, 3, 3, "bic", f, 2)
    state, now = y[-1], f[-1, 0]
    for _ in range(3):
        state, now = 0.5 * state + 0.7 * now, 0.8 * now
    assert (p, m) == (1, 1) and abs(value - state) < 0.25


def test_lag_example():
    rows = np.array([[i, 10 * i, 100 * i] for i in range(1, 10)], float)
    got = KL.lags(rows[:, 0], 3)
    assert np.isnan(got[:2, 2]).all() and got[8].tolist() == [9, 8, 7]


def test_factors_reproduce_the_panel_when_r_is_n():
    x = RNG.normal(size=(50, 5))
    loadings, f, eigen = KF.static_factors(x, 5)
    assert np.allclose(f @ loadings.T, x) and np.allclose(eigen.sum(), (x**2).sum())
    assert (loadings[np.abs(loadings).argmax(0), range(5)] > 0).all()


def test_factor_number_by_gaps_matches_its_steps():
    for trial in range(20):
        eigen = np.sort(np.r_[RNG.exponential(2, 18), RNG.uniform(5, 60, trial % 5)])[::-1]
        most = 8
        def step(j):
            d, k = eigen[j - 1 : j + 4], np.array([(j - 1 + i) ** (2 / 3) for i in range(5)])
            beta = ((k - k.mean()) * (d - d.mean())).sum() / ((k - k.mean()) ** 2).sum()
            over = [i + 1 for i in range(most) if eigen[i] - eigen[i + 1] >= 2 * abs(beta)]
            return over[-1] if over else 0
        r = step(most + 1)
        for _ in range(4):
            r = step(r + 1)
        assert KF.factor_count_gap(eigen, most) == r


def test_dynamic_factor_number_matches_its_definition():
    shocks = RNG.normal(size=(300, 2))
    f = np.zeros((300, 4))
    for t in range(1, 300):
        f[t] = 0.4 * f[t - 1] + shocks[t] @ np.array([[1.0, 0.2, 0.5, 0.3], [0.1, 1.0, -0.4, 0.6]])
    z = np.column_stack([np.ones(299), f[:-1]])
    e = f[1:] - z @ np.linalg.solve(z.T @ z, z.T @ f[1:])
    w = np.sort(np.linalg.eigvalsh(e.T @ e))[::-1]
    limit = 1 / min(30**0.4, 300**0.4)
    one = next((k for k in range(1, 4) if np.sqrt(w[k] ** 2 / (w**2).sum()) < limit), 1)
    rest = next((k for k in range(1, 4) if np.sqrt((w[k:] ** 2).sum() / (w**2).sum()) < limit), 1)
    assert KF.dynamic_factor_count(f, 1, 30) == (one, rest)
    assert KF.dynamic_factor_count(f, 1, 10**6)[0] == 2


def test_vector_autoregression_order():
    f = np.zeros((600, 2))
    for t in range(2, 600):
        f[t] = np.array([[0.3, 0.1], [0.0, 0.2]]) @ f[t - 1] + 0.4 * f[t - 2] + RNG.normal(size=2)
    assert KF.var_order(f, 4)["sc"] == KF.var_order(f, 4)["hq"] == 2


def test_factor_number_and_fill():
    f, load = RNG.normal(size=(200, 2)), RNG.uniform(0.5, 1.5, size=(30, 2)) * RNG.choice([-1, 1], size=(30, 2))
    x = f @ load.T + 0.5 * RNG.normal(size=(200, 30))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    counts = KF.factor_count_ic(KF.static_factors(z, 1)[2], 200, 30, 8)
    assert counts["ic1"] == counts["ic2"] == 2 and counts["pc2"] >= 2
    gap = x.copy()
    gap[RNG.random(x.shape) < 0.05] = np.nan
    assert np.abs(KF.factor_fill(gap, 2) - x)[np.isnan(gap)].mean() < 0.6


def test_kalman_with_much_signal_is_least_squares():
    load = RNG.normal(size=(12, 2))
    f = RNG.normal(size=(60, 2))
    x = f @ load.T
    filtered, smooth = KF.kalman(x, load, np.full(12, 1e-8), np.eye(2) * 0.5, np.eye(2))
    assert np.allclose(filtered, f, atol=1e-4) and np.allclose(smooth, f, atol=1e-3)


def test_adf_tells_noise_from_walks():
    noise = sum(KT.adf(RNG.normal(size=200))[0] < KT.critical(190) for _ in range(20))
    walks = sum(KT.adf(RNG.normal(size=200).cumsum())[0] < KT.critical(190) for _ in range(20))
    assert noise == 20 and walks <= 5


@pytest.mark.parametrize("statistic", ["R", "SQ"])
def test_confidence_set_keeps_the_better(statistic):
    mean = np.array([1.0, 5.0, 1.02])
    boot = mean + RNG.normal(size=(300, 3)) * 0.1
    order, p = KT.confidence_set(mean, boot, statistic)
    assert order[0] == 1 and order[-1] in (0, 2) and p[0] < 0.05 and p[-1] == 1.0 and (np.diff(p) >= 0).all()


def test_spline_follows_a_cubic():
    t = np.arange(20.0)
    y = 0.1 * t**3 - t**2 + 3
    gap = y.copy()
    gap[[0, 4, 5, 11, 19]] = np.nan
    got = spline_fill_values(gap)
    assert np.allclose(got[1:19], y[1:19]) and np.isnan(got[[0, 19]]).all()


def test_splines_of_many_vectors_at_once():
    import tracemalloc

    from panelcast.kernels.spline import spline_fill_many

    vectors = [RNG.normal(size=n) for n in (1, 2, 3, 4, 5, 9, 40, 90, 3, 17)]
    for y in vectors[1:]:
        y[RNG.random(len(y)) < 0.4] = np.nan
    vectors += [np.full(5, np.nan), np.array([np.nan, 1.0, np.nan, 4.0, np.nan, 9.0, np.nan]), np.array([1.0, np.nan, 27.0, 64.0, np.nan, 216.0])]
    got = spline_fill_many(np.concatenate(vectors), np.cumsum([0, *map(len, vectors)])[:-1])
    assert np.array_equal(got, np.concatenate([spline_fill_values(y) for y in vectors]), equal_nan=True)
    assert np.allclose(got[-6:], [1, 8, 27, 64, 125, 216]) and np.isnan(got[-7]) and np.isnan(got[-13])
    x = np.arange(4000.0)
    y = np.where(x % 3 == 1, np.nan, np.sin(x / 50))
    tracemalloc.start()
    filled = spline_fill_values(y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(filled - np.sin(x / 50))[1:-1].max() < 1e-5 and peak < 10_000_000  # no matrix of points by points
