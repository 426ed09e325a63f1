"""State space, fill in rounds, unit roots from moments, against doubles written here."""

import datetime as dt

import numpy as np
import pytest

from panelcast.kernels import factors as KF
from panelcast.kernels import inference as KT
from panelcast.operators import factors as FA
from panelcast.operators import stationary as ST

RNG = np.random.default_rng(21)


def long(spark, panels):
    """Matrices with NaN for gaps as rows; a panel a key."""
    rows = [(p, f"s{j}", dt.date(2000 + i // 12, i % 12 + 1, 1), None if np.isnan(v) else float(v)) for p, x in panels.items() for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "panel_id string, series string, ds date, value double")


def smoother(x, load, noise, a, q):
    """Conditional means of all states given all known values, from the joint normal distribution."""
    t, k = len(x), len(a)
    p0 = np.zeros((k, k))
    for i in range(3000):
        p0 = a @ p0 @ a.T + q
    cov = np.zeros((t * k, t * k))
    for i in range(t):
        for j in range(i, t):
            block = np.linalg.matrix_power(a, j - i) @ p0
            cov[j * k : (j + 1) * k, i * k : (i + 1) * k], cov[i * k : (i + 1) * k, j * k : (j + 1) * k] = block, block.T
    big = np.kron(np.eye(t), load)
    known = ~np.isnan(x.ravel())
    seen = big[known] @ cov @ big[known].T + np.diag(np.tile(noise, t)[known])
    return (cov @ big[known].T @ np.linalg.solve(seen, x.ravel()[known])).reshape(t, k)


@pytest.mark.parametrize("p,q", [(1, 2), (2, 2), (2, 1), (3, 1)])
def test_smoother_equals_the_joint_normal_distribution(p, q):
    r, n, t = 2, 5, 14
    lags = [np.array([[0.5, 0.1], [-0.2, 0.3]]) / (k + 1) for k in range(p)]
    e = RNG.normal(size=(40, r))
    a, cov = KF.companion(np.vstack([m.T for m in lags]), e.T @ e / 40, p, q)
    assert a.shape == (r * p, r * p) and np.linalg.matrix_rank(cov, 1e-9) == q
    assert np.allclose(a[:r], np.hstack(lags)) and np.allclose(a[r:, : r * (p - 1)], np.eye(r * (p - 1)))
    load, noise = np.hstack([RNG.normal(size=(n, r)), np.zeros((n, r * (p - 1)))]), RNG.uniform(0.2, 1, n)
    x = RNG.normal(size=(t, n))
    x[RNG.random((t, n)) < 0.3] = np.nan
    x[:3, 0], x[-2:, 1], x[6] = np.nan, np.nan, np.nan  # unequal starts and ends, a date without any value
    filtered, smooth = KF.kalman(x, load, noise, a, cov)
    assert np.allclose(smooth, smoother(x, load, noise, a, cov), atol=1e-8)
    assert np.allclose(filtered[-1], smooth[-1])
    assert np.allclose(filtered[7], smoother(x[:8], load, noise, a, cov)[7], atol=1e-8)


def test_stationary_start_and_shrunk_roots():
    a, q = KF.companion(np.vstack([np.eye(2) * 0.9, np.eye(2) * 0.4]), np.eye(2), 2, 2)
    assert abs(np.abs(np.linalg.eigvals(a)).max() - 0.99) < 1e-9
    p = KF.stationary_covariance(a, q)
    assert np.allclose(p, a @ p @ a.T + q) and np.linalg.eigvalsh(p).min() > -1e-9


def test_two_steps_keep_series_with_gaps():
    f = np.zeros((120, 2))
    for t in range(1, 120):
        f[t] = [0.8, 0.5] * f[t - 1] + RNG.normal(size=2)
    x = f @ RNG.normal(size=(2, 12)) + RNG.normal(size=(120, 12)) * 0.3
    holes = x.copy()
    holes[RNG.random(x.shape) < 0.1] = np.nan
    holes[-4:, ::3] = np.nan
    fit = KF.two_step(holes, 2, 2)
    assert fit["smooth"].shape == (120, 2) and np.isfinite(fit["smooth"]).all() and fit["loadings"].shape == (12, 4)
    b, *_ = np.linalg.lstsq(np.column_stack([np.ones(120), fit["smooth"]]), f, rcond=None)
    rest = f - np.column_stack([np.ones(120), fit["smooth"]]) @ b
    assert (rest.var(axis=0) < 0.1 * f.var(axis=0)).all()
    ahead = KF.state_forecast(fit, 3)
    state = fit["states"][-1]
    for _ in range(3):
        state = fit["a"] @ state
    assert np.allclose(ahead, fit["loadings"] @ state * fit["sd"] + fit["mean"]) and np.isfinite(ahead).all()
    odd = np.column_stack([holes, np.full(120, np.nan), np.ones(120)])
    assert np.isfinite(KF.two_step(odd, 2)["smooth"]).all()
    for small in (x[:30, :1], x[:2, :3], np.full((20, 2), np.nan), holes[:30, :3]):
        fit = KF.two_step(small, 4, 2, 3)
        assert fit["smooth"].shape == (len(small), min(4, small.shape[1])) and np.isfinite(fit["smooth"]).all() and np.isfinite(KF.state_forecast(fit, 2)).all()


def test_panels_with_gaps_keep_their_dates(spark):
    x = RNG.normal(size=(40, 6)).cumsum(axis=0)
    x[:5, 0], x[-3:, 1], x[10, 2] = np.nan, np.nan, np.nan
    df = long(spark, {"a": x})
    got = {(r.ds, r.factor): r.value for r in FA.two_step_factors(df, 2, 2, 1).collect()}
    want = KF.two_step(x, 2, 2, 1)["smooth"]
    assert len(got) == 80 and np.allclose([got[dt.date(2000 + i // 12, i % 12 + 1, 1), k + 1] for i in range(40) for k in range(2)], want.ravel())
    ahead = {r.series: r.y_pred for r in FA.state_forecasts(df, 2, 3, 2, 1).collect()}
    assert np.allclose([ahead[f"s{j}"] for j in range(6)], KF.state_forecast(KF.two_step(x, 2, 2, 1), 3))


def test_rounds_fill_as_one_task_does(spark):
    panels = {}
    for p, (t, n) in {"a": (30, 5), "b": (24, 8), "whole": (20, 4)}.items():
        f = RNG.normal(size=(t, 2)).cumsum(axis=0)
        panels[p] = f @ RNG.normal(size=(2, n)) + RNG.normal(size=(t, n)) * 0.2
        if p != "whole":
            panels[p][RNG.random((t, n)) < 0.1] = np.nan
    df = long(spark, panels)
    day = lambda i: dt.date(2000 + i // 12, i % 12 + 1, 1)
    for most in (1, 7):
        for rows in (FA.factor_fill(df, 2, most, 1e-5, most_cells=0), FA.factor_fill(df, 2, most, 1e-5, most_cells=160), FA.factor_fill(df, 2, most, 1e-5)):
            got = {(r.panel_id, r.series, r.ds): r.filled for r in rows.collect()}
            assert len(got) == sum(x.size for x in panels.values())
            for p, x in panels.items():
                want = KF.factor_fill(x, 2, most, 1e-5)
                assert np.allclose([[got[p, f"s{j}", day(i)] for j in range(x.shape[1])] for i in range(len(x))], want, atol=1e-6)


@pytest.mark.parametrize("ic", ["bic", "aic"])
def test_unit_roots_from_moments_equal_the_kernel(spark, ic):
    x = np.full((90, 8), np.nan)
    for j in range(8):
        e = RNG.normal(size=90)
        x[:, j] = e.cumsum() if j % 2 else e + 1000
    x[:, 2] = 0.4 * np.r_[0, 0, x[:-2, 1]] + x[:, 2]
    x[RNG.random(x.shape) < 0.05] = np.nan
    x[14:, 4], x[6:, 5], x[3:, 6], x[:, 7] = np.nan, np.nan, np.nan, np.nan
    got = {r.series: r for r in ST.adf(long(spark, {"p": x}), 10, ic).collect()}
    assert len(got) == 8
    for j in range(8):
        t, lag, n = KT.adf(x[:, j], 10, ic)
        r = got[f"s{j}"]
        assert (r.lag, r.n) == (lag, n) and abs(r.critical - KT.critical(max(n, 1))) < 1e-12
        assert (r.t is None) == bool(np.isnan(t)) and (r.t is None or abs(r.t - t) < 1e-6 * max(1, abs(t)))


def test_wide_panels_fill_by_series_as_one_task_does(spark):
    panels = {}
    for p, (t, n) in {"a": (12, 30), "b": (20, 25), "whole": (10, 14), "tall": (30, 6)}.items():
        f = RNG.normal(size=(t, 2)).cumsum(axis=0)
        panels[p] = f @ RNG.normal(size=(2, n)) + RNG.normal(size=(t, n)) * 0.2
        if p != "whole":
            panels[p][RNG.random((t, n)) < 0.1] = np.nan
    panels["a"][4:, 0], panels["a"][0, 0] = np.nan, 1.0
    df = long(spark, panels)
    # a series that starts late, as a calendar of its own leaves it: no rows, but cells of the panel
    late = df.where("not (panel_id = 'a' and series = 's0' and ds > date'2000-04-01')")
    day = lambda i: dt.date(2000 + i // 12, i % 12 + 1, 1)
    for most in (4,):
        for rows in (FA.factor_fill(late, 2, most, 1e-5, most_cells=0), FA.factor_fill(late, 2, most, 1e-5, most_cells=400)):
            got = {(r.panel_id, r.series, r.ds): r.filled for r in rows.collect()}
            assert len(got) == sum(x.size for x in panels.values())
            for p, x in panels.items():
                want = KF.factor_fill(x, 2, most, 1e-5)
                assert np.allclose([[got[p, f"s{j}", day(i)] for j in range(x.shape[1])] for i in range(len(x))], want, atol=1e-6), (p, most)


def test_fits_of_wide_panels_need_only_products_of_dates(monkeypatch):
    x = RNG.normal(size=(20, 60))
    loadings, f, _ = KF.static_factors(x, 3)
    seen, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: (seen.append(len(a)), eigh(a))[1])
    assert np.allclose(KF.factor_fit(x, 3), f @ loadings.T, atol=1e-9) and np.allclose(KF.factor_fit(x.T, 3).shape, (60, 20))
    assert set(seen) == {20}
