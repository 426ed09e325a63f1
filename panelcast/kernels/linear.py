"""Small dense regressions on one window: least squares, ridge and lasso paths on a Gram matrix, block validation."""

from __future__ import annotations

import numpy as np

from .gram import Run, run_of

FIRST_STAGE = (0.001, 500.0)  # fixed values: the range of ridge penalties of the adaptive lasso's first stage


def scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation by column; constant columns get deviation 1, so they become zeros."""
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    return mean, np.where(sd > 1e-12, sd, 1.0)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and sum of squared residuals."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, float(e @ e)


def criterion(ssr: float, n: int, k: int, ic: str) -> float:
    cost = {"aic": 2.0, "bic": np.log(n), "hq": 2 * np.log(np.log(n))}[ic]
    return float(np.log(max(ssr, 1e-300) / n) + k * cost / n)


def lambda_grid(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, steps: int = 200) -> np.ndarray:
    """Linear steps from the least penalty that selects nothing down to 1e-4 of it; x standardised, y centred."""
    return penalties(x.T @ y, len(y), alpha, steps)


def penalties(xy: np.ndarray, n: int, alpha: float = 1.0, steps: int = 200) -> np.ndarray:
    """``lambda_grid`` from X'y."""
    top = np.abs(xy).max(initial=0.0) / (n * max(alpha, 1e-3))
    return np.linspace(top, top * 1e-4, steps)


def lasso_path(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, alpha: float = 1.0, sweeps: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Elastic-net coefficients for each penalty (falling) on X'X/n and X'y/n.

    Minimises half the mean squared error + lambda (alpha |b|_1 + (1 - alpha)/2 |b|^2).  For alpha 1 the
    path is piecewise linear and is followed from knot to knot; for others, and where rounding hides a
    knot, from one active set to the next; where that breaks down (columns that depend on each other),
    by coordinate descent.
    """
    if alpha == 1.0 and (out := _knots(gram, xy, lambdas)) is not None:
        return out
    if alpha > 0 and (out := _active(gram, xy, lambdas, alpha)) is not None:
        return out
    return _descent(gram, xy, lambdas, alpha, sweeps, tol)


def _knots(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray) -> np.ndarray | None:
    """The lasso path from knot to knot; None where the optimality conditions aren't met at the end."""
    k, out = len(xy), np.zeros((len(lambdas), len(xy)))
    usable = np.diag(gram) > 1e-12
    top = np.abs(np.where(usable, xy, 0.0)).max(initial=0.0)
    if top <= 0:
        return out
    level, least, i = top, float(np.min(lambdas)), 0
    active, sign = [int(np.argmax(np.where(usable, np.abs(xy), -1.0)))], []
    sign = [float(np.sign(xy[active[0]]))]
    order = np.argsort(-np.asarray(lambdas), kind="stable")
    falling = np.asarray(lambdas)[order]
    i = int(np.searchsorted(-falling, -level, side="right"))
    left = -1  # the coefficient that has just become zero may not come back at once
    for _ in range(20 * k + 20):
        try:
            u, d = np.linalg.solve(gram[np.ix_(active, active)], np.column_stack([xy[active], sign])).T
        except np.linalg.LinAlgError:
            return None
        rest, slope = xy - gram[:, active] @ u, gram[:, active] @ d  # correlation at a level: rest + level * slope
        free = usable.copy()
        free[active] = False
        if left >= 0:
            free[left] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.stack([rest / (1 - slope), -rest / (1 + slope)])
            zeros = np.asarray(u) / np.asarray(d)
        meets[:, ~free] = -np.inf
        meets[~np.isfinite(meets) | (meets >= level - 1e-14 * top)] = -np.inf
        zeros[~np.isfinite(zeros) | (zeros >= level - 1e-12 * top)] = -np.inf
        enters, drops = meets.max(initial=-np.inf), zeros.max(initial=-np.inf)
        new = max(enters, drops, 0.0)
        j = int(np.searchsorted(-falling, -new, side="right"))
        if j > i:
            out[np.ix_(order[i:j], active)] = u - falling[i:j, None] * d
            i = j
        if i == len(order) or new <= min(least, 0.0):
            break
        level, left = new, -1
        if drops >= enters:
            at = int(zeros.argmax())
            left = active.pop(at)
            sign.pop(at)
            if not active:
                return None
        else:
            side, j = np.unravel_index(int(meets.argmax()), meets.shape)
            active.append(int(j))
            sign.append(1.0 if side == 0 else -1.0)
    if i < len(order):
        return None
    slack = xy - out @ gram
    pull = np.asarray(lambdas)[:, None]
    fits = np.where(out != 0, np.abs(slack - pull * np.sign(out)), np.abs(slack) - pull)
    return out if fits[:, usable].max(initial=0.0) <= 1e-7 * top else None


def _active(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, alpha: float) -> np.ndarray | None:
    """Elastic-net coefficients by solving for the active set, from that of the penalty before; None where it doesn't settle."""
    k, out = len(xy), np.zeros((len(lambdas), len(xy)))
    usable, sign = np.diag(gram) > 1e-12, np.zeros(len(xy))
    for i, lam in enumerate(lambdas):
        pull, ridge = lam * alpha, lam * (1 - alpha)
        for _ in range(6 * k + 10):
            on = np.flatnonzero(sign)
            b = np.zeros(k)
            if len(on):
                try:
                    b[on] = np.linalg.solve(gram[np.ix_(on, on)] + ridge * np.eye(len(on)), xy[on] - pull * sign[on])
                except np.linalg.LinAlgError:
                    return None
                wrong = on[b[on] * sign[on] <= 0]
                if len(wrong):
                    sign[wrong] = 0.0
                    continue
            slope = xy - gram @ b
            over = np.where(usable & (sign == 0), np.abs(slope) - pull, -np.inf)
            j = int(over.argmax())
            if over[j] <= 1e-10 * max(pull, 1e-300):
                break
            sign[j] = np.sign(slope[j])
        else:
            return None
        out[i] = b
    return out


def _descent(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, alpha: float, sweeps: int, tol: float) -> np.ndarray:
    """Coordinate descent, each penalty from the coefficients of the one before; full sweeps only to find who joins."""
    k = len(xy)
    b, out = np.zeros(k), np.zeros((len(lambdas), k))
    fit, diag = gram @ b, np.diag(gram)
    usable = np.flatnonzero(diag > 0)
    for i, lam in enumerate(lambdas):
        pull, ridge = lam * alpha, lam * (1 - alpha)
        for _ in range(sweeps):
            waiting = usable[(b[usable] != 0) | (np.abs(xy - fit)[usable] > pull)]
            most = 0.0
            for j in waiting:
                rho = xy[j] - fit[j] + diag[j] * b[j]
                new = np.sign(rho) * max(abs(rho) - pull, 0.0) / (diag[j] + ridge)
                if new != b[j]:
                    fit += gram[:, j] * (new - b[j])
                    most = max(most, abs(new - b[j]))
                    b[j] = new
            if most < tol:
                break
        out[i] = b
    return out


def ridge_path(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """Ridge coefficients for each penalty from one eigen-decomposition of X'X."""
    w, v = np.linalg.eigh(gram)
    return (v.T @ xy / (np.maximum(w, 0) + np.asarray(lambdas)[:, None])) @ v.T


def block_splits(n: int, h: int, ratio: float, test: int) -> list[tuple[slice, slice]]:
    """Rows of ``n`` pairs (x[s], y[s + h]): rolling training pairs, a gap of h, then test pairs; the last block takes the rest.

    The n pairs span n + h dates, and shares and blocks are counted in dates.  A test pair's x is at
    least h dates later than the last training x, so no training label is later than a test origin.
    """
    t = n + h
    train = int(np.floor(ratio * t))
    blocks = int((t - train - 2 * h) // test)
    out = []
    for b in range(max(blocks, 0)):
        a = b * test
        start = a + train + h
        out.append((slice(a, a + train), slice(start, t - h if b == blocks - 1 else start + test)))
    return out


def path(method: str, gram: np.ndarray, xy: np.ndarray, n: int, lambdas: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients for each penalty from the products of n standardised rows."""
    return ridge_path(gram, xy, lambdas) if method == "ridge" else lasso_path(gram / n, xy / n, lambdas, alpha)


def first_stage(run: Run, h: int, steps: int = 200, **cv) -> np.ndarray:
    """Weights of the adaptive lasso: absolute ridge coefficients at the ridge penalty chosen by block validation, plus 1e-6."""
    start = np.linspace(*FIRST_STAGE, steps)
    lam = start[block_cv("ridge", None, None, start, h, run=run, **cv).argmin()]
    return np.abs(ridge_path(run.gram, run.xy, np.array([lam]))[0]) + 1e-6


def block_cv(method: str, x: np.ndarray | None, y: np.ndarray | None, lambdas: np.ndarray, h: int, alpha: float = 1.0, ratio: float = 0.7, test: int = 5, run: Run | None = None) -> np.ndarray:
    """Mean squared test error of each penalty over the blocks; scaling, and the weights of ``adaptive``, from training rows only.

    The products of a block's training rows are differences of the prefix sums of ``run``, or of x and y.
    """
    run = run_of(x, y) if run is None else run
    errors = []
    for tr, te in block_splits(len(run), h, ratio, test):
        known = run.part(tr)
        if method == "adaptive":
            w = first_stage(known, h, ratio=ratio, test=test)
            b = path(method, known.gram * np.outer(w, w), known.xy * w, len(known), lambdas, alpha) * w
        else:
            b = path(method, known.gram, known.xy, len(known), lambdas, alpha)
        errors.append((known.missed(run.part(te), b) ** 2).mean(axis=1))
    return np.mean(errors, axis=0) if errors else np.zeros(len(lambdas))


def adaptive_search(score, start: float | tuple[float, float, float], steps: int = 25) -> float:
    """The best of ``steps`` penalties, searched from the best of three (``start``, or a tenth, once and ten times it).

    From the greatest of the three the search goes up, unless a penalty just below it is better, from the least
    down, unless one just above it is better, and from the middle towards the better neighbour: by x1.5 or x0.5 while
    each is the best so far.  After the first that isn't, each is the mean of the best two.
    """
    low, mid, high = sorted(start) if isinstance(start, tuple) else (start * 0.1, start, start * 10)
    seen = {lam: score(lam) for lam in (low, mid, high)}
    best = lambda k=1: sorted(seen, key=lambda lam: (seen[lam], lam))[:k]
    now = best()[0]
    if now == high:
        up = score(0.95 * high) >= seen[high]
    elif now == low:
        up = score(1.05 * low) < seen[low]
    else:
        up = seen[high] < seen[low]
    straight = True
    for _ in range(steps):
        now = best()[0] * (1.5 if up else 0.5) if straight else float(np.mean(best(2)))
        if now in seen:
            break
        seen[now] = score(now)
        straight = straight and best()[0] == now
    return best()[0]


def penalised(x: np.ndarray | None, y: np.ndarray | None, h: int, method: str = "lasso", alpha: float = 1.0, ic: str = "cv", steps: int = 200, run: Run | None = None, lam: float | None = None, **cv) -> dict:
    """Fits one window.  ``ic``: cv, aic, bic, or grid (adaptive search).  Coefficients are for standardised x.

    With ``lam`` that penalty is taken.  A window of a panel comes as ``run``, which shares prefix sums with all other windows and targets; otherwise
    it is all of x and y.
    """
    run = run_of(x, y) if run is None else run
    n, weights = len(run), np.ones(len(run.xy))
    if method == "adaptive":
        weights = first_stage(run, h, **cv)
    gram, xy = run.gram * np.outer(weights, weights), run.xy * weights
    kind = "ridge" if method == "ridge" else "lasso"
    lambdas = np.linspace(1e-3, 1e5, 200) if kind == "ridge" else penalties(xy, n, alpha, steps)
    if lam is not None:
        lambdas = np.array([lam])
    elif ic == "grid":
        start = tuple(float(v) for v in np.quantile(lambdas, [0.1, 0.5, 0.9]))
        lam = adaptive_search(lambda k: float(block_cv(method, None, None, np.array([k]), h, alpha, run=run, **cv)[0]), start)
        lambdas = np.array([lam])
    b = path(kind, gram, xy, n, lambdas, alpha)
    if ic in ("aic", "bic"):
        ssr = run.yy - 2 * b @ xy + ((b @ gram) * b).sum(axis=1)
        at = int(np.argmin([criterion(float(max(s, 0.0)), n, int((c != 0).sum()), ic) for s, c in zip(ssr, b)]))
    else:
        at = 0 if len(lambdas) == 1 else int(block_cv(method, None, None, lambdas, h, alpha, run=run, **cv).argmin())
    mse = float(max(run.yy - 2 * b[at] @ xy + b[at] @ gram @ b[at], 0.0)) / n
    return {"coef": b[at] * weights, "lambda": float(lambdas[at]), "idx": at, "mean": run.own["mean"], "sd": run.own["sd"], "const": run.const, "mse": mse, "path": b * weights, "lambdas": lambdas}


def predict(fit: dict, x: np.ndarray) -> np.ndarray:
    return fit["const"] + ((x - fit["mean"]) / fit["sd"]) @ fit["coef"]


def lags(y: np.ndarray, p: int) -> np.ndarray:
    """Columns y[t], y[t-1], ..., y[t-p+1]; rows without all of them are NaN."""
    out = np.full((len(y), p), np.nan)
    for i in range(p):
        out[i:, i] = y[: len(y) - i]
    return out


def ar_direct(y: np.ndarray, h: int, most: int = 6, ic: str = "bic", extra: np.ndarray | None = None, extra_lags: int = 0) -> tuple[float, int, int, float | None]:
    """h-step forecast from the end of y by a direct autoregression, with lags of ``extra`` columns; orders by criterion.

    All orders are compared on the same rows.  Returns forecast, AR lags, factor lags and the mean squared residual.
    """
    x = lags(y, most)
    f = [np.column_stack([np.vstack([np.full((k, extra.shape[1]), np.nan), extra[: len(y) - k]]) for k in range(m)]) for m in range(1, extra_lags + 1)] if extra is not None else []
    t = np.arange(len(y) - h)
    full = ~np.isnan(x[t]).any(axis=1) & ~np.isnan(y[t + h])
    if f:
        full &= ~np.isnan(f[-1][t]).any(axis=1)
    rows = t[full]
    best = None
    for p in range(1, most + 1):
        for m in range(len(f) + 1):
            if m == 0 and f:
                continue
            z = np.column_stack([np.ones(len(y)), x[:, :p], *([f[m - 1]] if m else [])])
            if len(rows) <= z.shape[1] + 1:
                continue
            b, ssr = ols(z[rows], y[rows + h])
            c = criterion(ssr, len(rows), z.shape[1], ic)
            if best is None or c < best[0] - 1e-12:
                best = (c, float(z[-1] @ b), p, m, ssr / len(rows))
    return best[1:] if best else (float("nan"), 0, 0, None)


def ar_iterated(y: np.ndarray, h: int, most: int = 6, ic: str = "bic", extra: np.ndarray | None = None, extra_lags: int = 0) -> tuple[float, int, int, float | None]:
    """h-step forecast by iterating a one-step autoregression, with lags of ``extra`` columns; orders by criterion.

    All orders are compared on the same rows.  Future values of the extra columns come from a
    vector autoregression of order 1 on themselves.  Returns as ``ar_direct``.
    """
    k = 0 if extra is None else extra.shape[1]
    least = max(most, extra_lags if k else 0)
    rows = np.arange(least - 1, len(y) - 1)
    past = lambda x, p: np.column_stack([x[rows - i] for i in range(p)])
    best = None
    for p in range(1, most + 1):
        for m in range(1, extra_lags + 1) if k else (0,):
            z = np.column_stack([np.ones(len(rows)), past(y, p), *([past(extra, m)] if m else [])])
            if len(rows) <= z.shape[1] + 1:
                continue
            b, ssr = ols(z, y[rows + 1])
            c = criterion(ssr, len(rows), z.shape[1], ic)
            if best is None or c < best[0] - 1e-12:
                best = (c, b, p, m, ssr / len(rows))
    if best is None:
        return float("nan"), 0, 0, None
    _, b, p, m, mse = best
    state, f = list(y[::-1][:p]), [] if not m else list(extra[::-1][:m])
    if m:
        step, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(extra) - 1), extra[:-1]]), extra[1:], rcond=None)
    for _ in range(h):
        new = float(b[0] + b[1 : p + 1] @ state + (b[p + 1 :] @ np.concatenate(f) if m else 0.0))
        state = [new, *state][:p]
        f = [step[0] + f[0] @ step[1:], *f][:m] if m else []
    return state[0], p, m, mse
