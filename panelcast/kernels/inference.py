"""Unit-root test and model confidence set on small arrays."""

from __future__ import annotations

import numpy as np

from .linear import criterion, ols


# fixed values: MacKinnon (2010), response surface for one variable, constant, 5 %: terms of 1, 1/n, 1/n^2, 1/n^3
CRITICAL = (-2.86154, -2.8903, -4.234, -40.04)


def adf(y: np.ndarray, most: int = 10, ic: str = "bic") -> tuple[float, int, int]:
    """Augmented Dickey-Fuller t with a constant, the lag by criterion on equal rows, and the rows used."""
    y = y[~np.isnan(y)]
    d = np.diff(y)
    most = min(most, max(0, len(d) // 3 - 2))
    best = None
    for p in range(most + 1):
        rows = np.arange(most, len(d))
        if len(rows) <= p + 3:
            break
        x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, p + 1)]])
        b, ssr = ols(x, d[rows])
        c = criterion(ssr, len(rows), x.shape[1], ic)
        if best is None or c < best[0] - 1e-12:
            cov = np.linalg.pinv(x.T @ x) * ssr / (len(rows) - x.shape[1])
            best = (c, float(b[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan"), p, len(rows))
    return best[1:] if best else (float("nan"), 0, 0)


def adf_from_moments(products: np.ndarray, rows: np.ndarray, most: np.ndarray, ic: str = "bic", fixed: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t and lag of many series at once, as ``adf`` gives them, and which have a regression.

    ``products`` has for each series the sums of products of (1, difference, level before, differences before) over its
    ``rows`` rows; ``most`` is the greatest lag of each.  With ``fixed`` that lag is taken.
    """
    n, best, t, lag = len(rows), np.full(len(rows), np.inf), np.full(len(rows), np.nan), np.zeros(len(rows), int)
    for p in range(products.shape[1] - 2):
        at = [0, *range(2, 3 + p)]
        xx, xy, yy = products[:, at][:, :, at], products[:, at, 1], products[:, 1, 1]
        size = np.sqrt(np.maximum(np.einsum("sii->si", xx), 1e-300))
        inverse = np.linalg.pinv(xx / size[:, :, None] / size[:, None, :], rcond=1e-12, hermitian=True) if n else xx
        b = np.einsum("sij,sj->si", inverse, xy / size)
        ssr = np.maximum(yy - np.einsum("si,si->s", b, xy / size), 0.0)
        usable = (p <= most) & (rows > p + 3) & (p == fixed if fixed is not None else True)
        safe = np.maximum(rows, 2)
        cost = {"aic": 2.0, "bic": np.log(safe)}[ic]
        score = np.log(np.maximum(ssr, 1e-300) / safe) + (p + 2) * cost / safe
        better = usable & (score < best - 1e-12)
        variance = inverse[:, 1, 1] * ssr / np.maximum(rows - p - 2, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(variance > 0, b[:, 1] / np.sqrt(variance), np.nan)
        best, t, lag = np.where(better, score, best), np.where(better, value, t), np.where(better, p, lag)
    return t, lag, np.isfinite(best)


def critical(n: int) -> float:
    """5 % critical value with a constant."""
    return sum(c / n**i for i, c in enumerate(CRITICAL))


def confidence_set(mean: np.ndarray, boot: np.ndarray, statistic: str = "R") -> tuple[list[int], np.ndarray]:
    """Elimination order and running-greatest p values of models by the range (R) or sum of squares (SQ) statistic.

    ``mean`` holds the mean loss of each model, ``boot`` (draws x models) those of the bootstrap samples.
    """
    left, order, p, top = list(range(len(mean))), [], [], 0.0
    centred = boot - mean
    while len(left) > 1:
        i = np.array(left)
        d = mean[i][:, None] - mean[i][None, :]
        db = centred[:, i][:, :, None] - centred[:, i][:, None, :]
        sd = np.sqrt((db**2).mean(axis=0))
        np.fill_diagonal(sd, 1.0)
        sd = np.maximum(sd, 1e-12)
        t, tb = d / sd, db / sd
        if statistic == "R":
            value, draws = np.abs(t).max(), np.abs(tb).max(axis=(1, 2))
        else:
            value, draws = (t**2).sum() / 2, (tb**2).sum(axis=(1, 2)) / 2
        top = max(top, float((draws >= value).mean()))
        worst = left[int(t.max(axis=1).argmax())] if statistic == "R" else left[int((t.sum(axis=1)).argmax())]
        order.append(worst)
        p.append(top)
        left.remove(worst)
    return [*order, *left], np.array([*p, 1.0][: len(mean)])
