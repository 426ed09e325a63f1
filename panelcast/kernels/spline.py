"""Not-a-knot cubic splines through the known points of vectors."""

from __future__ import annotations

import numpy as np


def spline_fill_values(y: np.ndarray) -> np.ndarray:
    """Fills gaps between the first and the last known value; fewer than four known points use the polynomial through them."""
    return spline_fill_many(y, np.zeros(1, int))


def spline_fill_many(y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``spline_fill_values`` of many vectors that lie one after the other in ``y``, from ``starts`` on."""
    y = np.array(y, float)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
    at = np.flatnonzero(~np.isnan(y))
    n = np.bincount(owner[at], minlength=len(starts))  # known points by vector
    first = np.cumsum(n) - n
    x, v, m = at.astype(float), y[at], np.zeros(len(at))
    for size in np.unique(np.frexp(n[n > 2])[1]):  # vectors of similar lengths together, so padding at most doubles them
        these = np.flatnonzero((n > 2) & (np.frexp(n)[1] == size))
        place = first[these, None] + np.minimum(np.arange(n[these].max()), n[these, None] - 1)
        m2 = _second(x[place], v[place], n[these])
        inside = np.arange(place.shape[1]) < n[these, None]
        m[place[inside]] = m2[inside]
    gaps = np.flatnonzero(np.isnan(y))
    k = np.searchsorted(at, gaps) - 1
    ok = (k >= 0) & (k + 1 < len(at))
    gaps, k = gaps[ok], k[ok]
    ok = (owner[at[k]] == owner[gaps]) & (owner[at[k + 1]] == owner[gaps])
    gaps, k = gaps[ok], k[ok]
    u, w = gaps - x[k], x[k + 1] - gaps
    g = u + w
    y[gaps] = (m[k] * w**3 + m[k + 1] * u**3) / (6 * g) + (v[k] / g - m[k] * g / 6) * w + (v[k + 1] / g - m[k + 1] * g / 6) * u
    return y


def _second(x: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Second derivatives at ``n`` > 2 points of each row: continuity inside, equal third derivatives at the second knots.

    The first and last are written by their neighbours, which leaves a tridiagonal system with dominant diagonal,
    solved for all rows at once.  Three points have one second derivative.
    """
    rows, m = np.arange(len(n)), np.zeros(x.shape)
    h = np.diff(x, axis=1)
    inner = np.arange(1, x.shape[1] - 1) < n[:, None] - 1  # column j is point j + 1
    h = np.where(np.arange(h.shape[1]) < n[:, None] - 1, h, 1.0)
    s = np.diff(v, axis=1) / h
    a, b, c = h[:, :-1].copy(), 2 * (h[:, :-1] + h[:, 1:]), h[:, 1:].copy()
    d = 6 * np.diff(s, axis=1)
    four, last = n > 3, n - 3
    h0, h1, p, q = h[:, 0], h[:, 1], h[rows, n - 2], h[rows, n - 3]
    b[:, 0] += np.where(four, h0 * (h0 + h1) / h1, h0 + h1)  # three points: b is 3 (h0 + h1), all second derivatives are equal
    c[:, 0] -= np.where(four, h0**2 / h1, 0.0)
    b[rows, last] += np.where(four, p * (p + q) / q, 0.0)
    a[rows, last] -= np.where(four, p**2 / q, 0.0)
    a[:, 0], c[rows, last] = 0.0, 0.0
    a, b, c, d = np.where(inner, a, 0.0), np.where(inner, b, 1.0), np.where(inner, c, 0.0), np.where(inner, d, 0.0)
    for j in range(1, b.shape[1]):
        f = a[:, j] / b[:, j - 1]
        b[:, j] -= f * c[:, j - 1]
        d[:, j] -= f * d[:, j - 1]
    for j in range(b.shape[1] - 1, -1, -1):
        m[:, j + 1] = (d[:, j] - c[:, j] * m[:, j + 2]) / b[:, j]
    m[:, 0] = np.where(four, ((h0 + h1) * m[:, 1] - h0 * m[:, 2]) / h1, m[:, 1])
    m[rows, n - 1] = np.where(four, ((p + q) * m[rows, n - 2] - p * m[rows, n - 3]) / q, m[:, 1])
    return m
