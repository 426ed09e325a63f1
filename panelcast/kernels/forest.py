"""Regression forests on one window: all trees of a forest grow together, level by level, from histograms of binned features.

Bags are Poisson weights, so the rows that a tree never saw are known, and errors and importances come from them.
All chance comes from integer hashes of (seed, tree, row or node), so a forest is the same wherever it is grown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# fixed values: the cumulative Poisson(1) probabilities of 0, 1, 2, ... in units of 2^-64
_STEPS = np.array([min(int(sum(np.exp(-1.0) / np.prod(np.arange(1, j + 1), dtype=float) for j in range(k + 1)) * 2.0**64), 2**64 - 1) for k in range(8)], np.uint64)
TABLE = 256  # orders of features that nodes draw from


def mix(*parts: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of integers, by the finaliser of splitmix64 (Steele, Lea and Flood 2014) after each part."""
    h = np.zeros(np.broadcast_shapes(*[np.shape(p) for p in parts]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def bags(trees: int, n: int, seed: int) -> np.ndarray:
    """trees x rows weights, each Poisson with mean 1."""
    return np.searchsorted(_STEPS, mix(seed, 1, np.arange(trees)[:, None], np.arange(n)[None, :]), side="right").astype(float)


def orders(p: int, seed: int) -> np.ndarray:
    """``TABLE`` orders of the features; a node tries the first of one of them."""
    return np.argsort(mix(seed, 2, np.arange(TABLE)[:, None], np.arange(p)[None, :]), axis=1, kind="stable")


def binned(x: np.ndarray, most: int = 32, known: int | None = None) -> np.ndarray:
    """Each column as places between at most ``most - 1`` quantiles of its first ``known`` rows."""
    known = len(x) if known is None else known
    out = np.zeros(x.shape, np.int64)
    for j in range(x.shape[1]):
        own = np.unique(x[:known, j])
        if len(own) > most:
            own = np.unique(np.quantile(x[:known, j], np.arange(1, most + 1) / most, method="higher"))
        out[:, j] = np.searchsorted(own[:-1], x[:, j], side="left")
    return out


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes, the children of i are 2 i + 1 and 2 i + 2; -1 for a leaf
    cut: np.ndarray  # the left child takes bins up to it
    value: np.ndarray
    weight: np.ndarray  # trees x training rows
    depth: int

    def predictions(self, bins: np.ndarray, trees: np.ndarray | None = None, changed: tuple[int, np.ndarray] | None = None) -> np.ndarray:
        """trees x rows; with ``changed`` a feature's bins are those given, trees x rows."""
        trees = np.arange(len(self.feature)) if trees is None else trees
        at, t, rows = np.zeros((len(trees), len(bins)), np.int64), trees[:, None], np.arange(len(bins))[None, :]
        for _ in range(self.depth):
            f = self.feature[t, at]
            b = bins[rows, f]
            if changed is not None:
                b = np.where(f == changed[0], changed[1], b)
            at = np.where(f >= 0, 2 * at + 1 + (b > self.cut[t, at]), at)
        return self.value[t, at]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.predictions(bins).mean(axis=0)

    def unseen_error(self, bins: np.ndarray, y: np.ndarray) -> float:
        """Mean squared error of each training row by the trees that never saw it."""
        out = self.weight == 0
        n = out.sum(axis=0)
        mean = np.where(out, self.predictions(bins), 0.0).sum(axis=0)[n > 0] / n[n > 0]
        return float(((y[n > 0] - mean) ** 2).mean()) if len(mean) else float("nan")

    def importance(self, bins: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
        """By feature: the rise of a tree's mean squared error on rows it never saw when the feature's values trade places among them.

        The mean over trees is divided by its deviation over trees; 0 for a feature no tree uses.  The unseen rows of a tree
        pass their values on in a hashed cycle.
        """
        unseen = self.weight == 0
        trees, n = unseen.shape
        order = np.argsort(np.where(unseen, mix(seed, 3, np.arange(trees)[:, None], np.arange(n)[None, :]) >> np.uint64(1), np.uint64(2**64 - 1)), axis=1, kind="stable")
        size = unseen.sum(axis=1)
        place = np.arange(n)[None, :]
        source = np.empty((trees, n), np.int64)
        np.put_along_axis(source, order, np.take_along_axis(order, np.where(place < size[:, None], (place + 1) % np.maximum(size, 1)[:, None], place), axis=1), axis=1)
        mse = lambda pred, of: np.where(unseen[of], (y[None, :] - pred) ** 2, 0.0).sum(axis=1) / np.maximum(size[of], 1)
        base = mse(self.predictions(bins), np.arange(trees))
        out = np.zeros(bins.shape[1])
        for f in range(bins.shape[1]):
            of = np.flatnonzero((self.feature == f).any(axis=1) & (size > 0))
            if len(of):
                rise = np.zeros(trees)
                rise[of] = mse(self.predictions(bins, of, (f, bins[source[of], f])), of) - base[of]
                spread = rise.std(ddof=1) if trees > 1 else 1.0
                out[f] = rise.mean() / spread if spread > 0 else 0.0
        return out


def grow(bins: np.ndarray, y: np.ndarray, trees: int, seed: int = 7, depth: int = 8, least: int = 5, tries: int | None = None, at_once: int = 100) -> Forest:
    """A forest of ``trees`` on all rows of ``bins``; a split leaves a weight of ``least`` on both sides and looks at ``tries`` features (a third)."""
    n, p = bins.shape
    weight, order = bags(trees, n, seed), orders(p, seed)
    tries = max(1, p // 3) if tries is None else min(tries, p)
    nodes = 2 ** (depth + 1) - 1
    out = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), weight, depth)
    for first in range(0, trees, at_once):
        _grow(out, bins, y, np.arange(first, min(trees, first + at_once)), order[:, :tries], seed, least)
    return out


def _grow(forest: Forest, bins: np.ndarray, y: np.ndarray, trees: np.ndarray, order: np.ndarray, seed: int, least: int) -> None:
    i, row = np.nonzero(forest.weight[trees])
    tree, w = trees[i], forest.weight[trees[i], row]
    node, size, tries = np.zeros(len(row), np.int64), int(bins.max(initial=0)) + 1, order.shape[1]
    for level in range(forest.depth + 1):
        if not len(row):
            return
        key, of = np.unique(tree * forest.feature.shape[1] + node, return_inverse=True)
        key_tree, key_node = np.divmod(key, forest.feature.shape[1])
        count, total = np.bincount(of, w), np.bincount(of, w * y[row])
        forest.value[key_tree, key_node] = total / count
        large = count >= 2 * least  # others can't be split
        if level == forest.depth or not large.any():
            return
        on = large[of]
        tree, row, w, node, of = tree[on], row[on], w[on], node[on], (large.cumsum() - 1)[of[on]]
        key_tree, key_node, key, count, total = (v[large] for v in (key_tree, key_node, key, count, total))
        subset = order[(mix(seed, 4, key_tree, key_node) % np.uint64(TABLE)).astype(np.int64)]  # nodes x tries
        place = (of[:, None] * tries + np.arange(tries)) * size + bins[row[:, None], subset[of]]
        shape, flat = (len(key), tries, size), place.ravel()
        n_left = np.bincount(flat, np.repeat(w, tries), len(key) * tries * size).reshape(shape).cumsum(axis=2)
        s_left = np.bincount(flat, np.repeat(w * y[row], tries), len(key) * tries * size).reshape(shape).cumsum(axis=2)
        n_right, s_right = count[:, None, None] - n_left, total[:, None, None] - s_left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n_left >= least) & (n_right >= least), s_left**2 / n_left + s_right**2 / n_right, -np.inf).reshape(len(key), -1)
        best = gain.argmax(axis=1)
        floor = total**2 / count
        split = gain[np.arange(len(key)), best] > floor + 1e-9 * np.maximum(np.abs(floor), 1e-12)
        k, cut = np.divmod(best, size)
        chosen = subset[np.arange(len(key)), k]
        forest.feature[key_tree[split], key_node[split]] = chosen[split]
        forest.cut[key_tree[split], key_node[split]] = cut[split]
        on = split[of]
        tree, row, w, of, node = tree[on], row[on], w[on], of[on], node[on]
        node = 2 * node + 1 + (bins[row, chosen[of]] > cut[of])
