"""Products of standardised training pairs over any run of rows, as differences of prefix sums."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def deviation(squares: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation from centred sums of squares; constant columns get 1, so they become zeros."""
    sd = np.sqrt(np.maximum(squares, 0.0) / max(n - 1, 1))
    return np.where(sd > 1e-12, sd, 1.0)


class Pairs:
    """Rows x and labels y (one column a target), with prefix sums of x, y, x x', x y' and y y.

    A sum over rows a to b is the difference of two prefixes, so windows, and the blocks of each of them, never go
    through their rows again.  Rows are taken less the mean of the first ``first`` of them against cancellation, so no sum
    depends on later rows.  Where prefixes would hold more than ``most_numbers`` numbers, sums are taken
    from the rows.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, first: int = 24, most_numbers: int = 1 << 24):
        self.x, self.y = x, y
        self.near_x, self.near_y = x[:first].mean(axis=0), y[:first].mean(axis=0)
        self.u, self.v = x - self.near_x, y - self.near_y
        self.kept: dict = {}
        n, k = x.shape
        self.prefixes = None
        if (n + 1) * k * (k + y.shape[1]) <= most_numbers:
            parts = self.u, self.v, self.u[:, :, None] * self.u[:, None, :], self.u[:, :, None] * self.v[:, None, :], self.v**2
            self.prefixes = [np.concatenate([np.zeros((1, *p.shape[1:])), p.cumsum(axis=0)]) for p in parts]

    def sums(self, a: int, b: int) -> list[np.ndarray]:
        """Sums of x, y, x x', x y', y y over rows a to b, all centred on ``near``."""
        if self.prefixes is not None:
            return [p[b] - p[a] for p in self.prefixes]
        u, v = self.u[a:b], self.v[a:b]
        return [u.sum(axis=0), v.sum(axis=0), u.T @ u, u.T @ v, (v**2).sum(axis=0)]

    def standard(self, a: int, b: int) -> dict:
        """Means, deviations and products of standardised x with themselves and with centred y; kept until ``forget``."""
        if (a, b) not in self.kept:
            n = b - a
            su, sv, uu, uv, vv = self.sums(a, b)
            gram = uu - np.outer(su, su) / n
            sd = deviation(np.diag(gram), n)
            self.kept[a, b] = {
                "n": n, "mean": su / n + self.near_x, "sd": sd, "gram": gram / np.outer(sd, sd), "const": sv / n + self.near_y,
                "xy": (uv - np.outer(su, sv) / n) / sd[:, None], "yy": np.maximum(vv - sv**2 / n, 0.0),
            }
        return self.kept[a, b]

    def forget(self) -> None:
        self.kept.clear()


@dataclass
class Run:
    """Rows ``a`` to ``b`` of ``pairs`` with the labels of one target."""

    pairs: Pairs
    a: int
    b: int
    target: int = 0
    _own: dict | None = field(default=None, repr=False)

    def part(self, rows: slice) -> Run:
        return Run(self.pairs, self.a + rows.start, self.a + rows.stop, self.target)

    def __len__(self) -> int:
        return self.b - self.a

    @property
    def own(self) -> dict:
        if self._own is None:
            self._own = self.pairs.standard(self.a, self.b)
        return self._own

    @property
    def gram(self) -> np.ndarray:
        return self.own["gram"]

    @property
    def xy(self) -> np.ndarray:
        return self.own["xy"][:, self.target]

    @property
    def yy(self) -> float:
        return float(self.own["yy"][self.target])

    @property
    def const(self) -> float:
        return float(self.own["const"][self.target])

    def missed(self, other: Run, b: np.ndarray) -> np.ndarray:
        """Residuals of the rows of ``other`` for each row of coefficients ``b``, fitted on this run."""
        z = (other.pairs.x[other.a : other.b] - self.own["mean"]) / self.own["sd"]
        return (other.pairs.y[other.a : other.b, other.target] - self.const)[None, :] - b @ z.T


def run_of(x: np.ndarray, y: np.ndarray) -> Run:
    """All rows of one matrix and its labels."""
    return Run(Pairs(x, y[:, None]), 0, len(y))
