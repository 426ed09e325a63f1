"""Factor models of one panel matrix: static factors, their number, fill by iteration, vector autoregression, Kalman."""

from __future__ import annotations

import numpy as np

from .linear import ols, scale


def gram_loadings(gram: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings sqrt(N) times eigenvectors of X'X, and all its eigenvalues in falling order.

    The sign makes each factor's largest absolute loading positive.
    """
    w, v = np.linalg.eigh(gram)
    w, v = w[::-1], v[:, ::-1][:, :r]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return np.sqrt(len(gram)) * v, np.maximum(w, 0)


def static_factors(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings, factors X L / N, and all eigenvalues of X'X in falling order."""
    loadings, w = gram_loadings(x.T @ x, r)
    return loadings, x @ loadings / x.shape[1], w


def factor_count_ic(eigen: np.ndarray, t: int, n: int, most: int) -> dict[str, int]:
    """Numbers of factors by the PC and IC criteria of Bai and Ng (2002); the variance is that with ``most`` factors."""
    v = np.array([eigen[k:].sum() for k in range(most + 1)]) / (n * t)
    small = min(n, t)
    g = {"1": (n + t) / (n * t) * np.log(n * t / (n + t)), "2": (n + t) / (n * t) * np.log(small), "3": np.log(small) / small}
    k = np.arange(most + 1)
    out = {f"pc{i}": int((v + k * v[most] * p)[1:].argmin() + 1) for i, p in g.items()}
    return out | {f"ic{i}": int((np.log(np.maximum(v, 1e-300)) + k * p).argmin()) for i, p in g.items()}


def factor_count_gap(eigen: np.ndarray, most: int, rounds: int = 4) -> int:
    """Number of factors by eigenvalue differences (Onatski 2010): a threshold from the slope of eigenvalues beyond a start.

    ``eigen`` are those of the sample covariance.  The rule is applied once and then ``rounds`` times more,
    each time from the number found before.
    """
    j, count = most + 1, 0
    for _ in range(rounds + 1 if most > 0 else 0):
        at = np.arange(j - 1, j + 4)
        if at[-1] >= len(eigen):
            break
        slope, _ = ols(np.column_stack([np.ones(5), (at + 0.0) ** (2 / 3)]), eigen[at])
        gap = 2 * abs(slope[1])
        found = np.flatnonzero(eigen[:most] - eigen[1 : most + 1] >= gap)
        count = int(found[-1] + 1) if len(found) else 0
        j = count + 1
    return count


def factor_fit(z: np.ndarray, r: int) -> np.ndarray:
    """The fit of r factors, from the products of dates or of series, whichever are fewer: both give the same projection."""
    if z.shape[0] < z.shape[1]:
        u = gram_basis(z @ z.T, r)
        return u @ (u.T @ z)
    loadings, factors, _ = static_factors(z, min(r, z.shape[1]))
    return factors @ loadings.T


def gram_basis(gram: np.ndarray, r: int) -> np.ndarray:
    """Eigenvectors of the r greatest eigenvalues, in falling order."""
    return np.linalg.eigh(gram)[1][:, ::-1][:, :r]


def factor_fill(x: np.ndarray, r: int, most: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Gaps filled by iteration: column means first, then the fit of r factors, until fits stand still."""
    gap = np.isnan(x)
    if not gap.any():
        return x.copy()
    known = (~gap).sum(axis=0)
    mean = np.where(known > 0, np.nansum(x, axis=0) / np.maximum(known, 1), 0.0)
    out, before = np.where(gap, mean, x), None
    for _ in range(most):
        m, s = scale(out)
        fit = factor_fit((out - m) / s, r) * s + m
        out = np.where(gap, fit, x)
        if before is not None and ((fit - before) ** 2).sum() / max((before**2).sum(), 1e-300) < tol:
            break
        before = fit
    return out


def var_fit(f: np.ndarray, p: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first, if any, then lags) and residuals of a vector autoregression."""
    z = np.column_stack([*([np.ones(len(f) - p)] if constant else []), *[f[p - k - 1 : len(f) - k - 1] for k in range(p)]])
    b, *_ = np.linalg.lstsq(z, f[p:], rcond=None)
    return b, f[p:] - z @ b


def var_order(f: np.ndarray, most: int) -> dict[str, int]:
    """Order by FPE, AIC, HQ and SC on the same rows."""
    t, k, rows = len(f) - most, f.shape[1], {}
    for p in range(1, most + 1):
        _, e = var_fit(f[most - p :], p)
        det = max(np.linalg.det(e.T @ e / t), 1e-300)
        n = p * k * k
        rows[p] = {"fpe": ((t + k * p + 1) / (t - k * p - 1)) ** k * det, "aic": np.log(det) + 2 * n / t, "hq": np.log(det) + 2 * np.log(np.log(t)) * n / t, "sc": np.log(det) + np.log(t) * n / t}
    return {c: min(rows, key=lambda p: (rows[p][c], p)) for c in ("fpe", "aic", "hq", "sc")}


def dynamic_factor_count(f: np.ndarray, p: int, n: int, most: int | None = None) -> tuple[int, int]:
    """Numbers of dynamic shocks behind static factors (Bai and Ng 2007), from the eigenvalues of the residual products of a VAR(p).

    The first number is the least k whose next eigenvalue, the second the least k whose further eigenvalues
    together, have a share (root of squares over those of all ``most``) below 1 / min(N, T)^0.4; 1 where none has.
    """
    _, e = var_fit(f, p)
    w = np.linalg.eigvalsh(e.T @ e)[::-1][: most or f.shape[1]]
    limit, whole = min(n, len(f)) ** -0.4, max((w**2).sum(), 1e-300)
    one = np.sqrt(w[1:] ** 2 / whole) < limit
    rest = np.sqrt(np.array([(w[k:] ** 2).sum() for k in range(1, len(w))]) / whole) < limit
    return tuple(int(x.argmax() + 1) if x.any() else 1 for x in (one, rest))


def stationary_covariance(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The covariance P = a P a' + q of a stationary state."""
    k = len(a)
    p = np.linalg.solve(np.eye(k * k) - np.kron(a, a), q.ravel()).reshape(k, k)
    return (p + p.T) / 2


def kalman(x: np.ndarray, loadings: np.ndarray, r: np.ndarray, a: np.ndarray, q: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered and smoothed states of x = L f + noise(diag r), f = A f(-1) + shock(q); NaN entries of x are skipped.

    The first state has mean 0 and covariance ``start``, the stationary one where None.  Noise is diagonal, so only
    states x states matrices are solved, and no covariance of states is inverted, so it may be singular (lags in the
    state, fewer shocks than states).  The smoother runs backwards over weighted residuals.
    """
    k = len(a)
    fp, pp = np.zeros(k), stationary_covariance(a, q) if start is None else start
    kept, filtered = [], np.zeros((len(x), k))
    for t, row in enumerate(x):
        ok = ~np.isnan(row)
        lw = loadings[ok] / r[ok][:, None]
        m = loadings[ok].T @ lw
        both = np.linalg.solve(np.eye(k) + m @ pp, np.column_stack([lw.T @ (row[ok] - loadings[ok] @ fp), m]))
        u, n = both[:, 0], both[:, 1:]  # residuals and loadings over the covariance of the rows
        kept.append((fp, pp, u, n))
        filtered[t] = fp + pp @ u
        fp, pp = a @ filtered[t], a @ (pp - pp @ n @ pp) @ a.T + q
        pp = (pp + pp.T) / 2
    smooth, back = np.zeros_like(filtered), np.zeros(k)
    for t in range(len(x) - 1, -1, -1):
        fp, pp, u, n = kept[t]
        back = u + (np.eye(k) - n @ pp) @ a.T @ back
        smooth[t] = fp + pp @ back
    return filtered, smooth


def companion(coefficients: np.ndarray, shocks: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Transition and shock covariance of the state (f, f(-1), ..., f(1 - p)), with ``q`` independent shocks.

    ``coefficients`` has the lags of a VAR(p) below each other.  Of the shock covariance the ``q`` greatest principal
    components stay.  Where the autoregression isn't stationary, lag k is shrunk by s^k until its greatest root is 0.99.
    """
    r = shocks.shape[0]
    w, v = np.linalg.eigh(shocks)
    v, w = v[:, ::-1][:, :q], np.maximum(w[::-1][:q], 0.0)
    a, cov = np.zeros((r * p, r * p)), np.zeros((r * p, r * p))
    a[r:, :-r] = np.eye(r * (p - 1)) if p > 1 else a[r:, :-r]
    cov[:r, :r] = (v * w) @ v.T
    a[:r] = np.hstack([coefficients[k * r : (k + 1) * r].T for k in range(p)])
    root = np.abs(np.linalg.eigvals(a)).max()
    if root >= 0.99:
        a[:r] *= np.repeat((0.99 / root) ** np.arange(1, p + 1), r)
    return a, cov


def two_step(x: np.ndarray, r: int, p: int = 1, q: int | None = None) -> dict:
    """Principal components and a VAR(p) with ``q`` shocks give the start values, the Kalman filter and smoother the factors.

    Gaps stay gaps for the filter; for the start values only they are filled by iteration.  A series without two
    values, or a constant one, counts as zeros.  There are at most as many factors as series; a panel of
    ``p`` + 1 dates or fewer has no autoregression.
    """
    known, r = ~np.isnan(x), min(r, x.shape[1])
    mean = np.array([c[k].mean() if k.any() else 0.0 for c, k in zip(x.T, known.T)])
    sd = np.array([c[k].std(ddof=1) if k.sum() > 1 else 0.0 for c, k in zip(x.T, known.T)])
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (x - mean) / sd
    full = factor_fill(z, r)
    loadings, f, _ = static_factors(full, r)
    b, e = var_fit(f, p, constant=False) if len(f) > p + 1 else (np.zeros((r * p, r)), f)
    noise = np.array([max(((c[k] - f[k] @ row) ** 2).mean() if k.any() else 1.0, 1e-4) for c, k, row in zip(z.T, known.T, loadings)])
    a, cov = companion(b, e.T @ e / len(e), p, r if q is None else min(q, r))
    wide = np.hstack([loadings, np.zeros((len(loadings), r * (p - 1)))])
    filtered, smooth = kalman(z, wide, noise, a, cov)
    return {"loadings": wide, "a": a, "q": cov, "noise": noise, "states": filtered, "filtered": filtered[:, :r], "smooth": smooth[:, :r], "mean": mean, "sd": sd}


def state_forecast(fit: dict, h: int) -> np.ndarray:
    """h-step forecast of every series from the last state, in its own units."""
    state = np.linalg.matrix_power(fit["a"], h) @ fit["states"][-1]
    return fit["loadings"] @ state * fit["sd"] + fit["mean"]
