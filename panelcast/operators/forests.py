"""Forests for every window and target: forecasts and selections, a small forest a task's unit of work.

A forest of one window is bounded by the window's rows and the panel's series, so thousands of them are dealt over
tasks like the regressions of ``linear``; nothing is fitted on the driver, and no window knows another's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import factors as KF
from ..kernels import forest as K
from ..kernels.linear import scale
from . import linear as L

SELECTION = L.SELECTION + ", round int"


def _seed(info: dict, more: int = 0) -> int:
    """A number of the window and horizon, so that forests of different windows don't share their bags."""
    return info["window"] * 1000 + info["h"] * 31 + more


def lagged(history: np.ndarray, names: list[str], components: int, lags: int) -> tuple[np.ndarray, list[str]]:
    """Rows of a window as features: principal components of its series, then the series, each with its lags; rows without all lags are left out.

    Components come from standardised rows up to the origin; there are fewer where the panel has fewer series.
    """
    mean, sd = scale(history)
    r = min(components, history.shape[1])
    base = np.column_stack([KF.static_factors((history - mean) / sd, r)[1], history]) if r else history
    base_names = [f"PCA{k + 1}" for k in range(r)] + list(names)
    t = len(base)
    made = [base[lags - k : t - k] for k in range(lags + 1)]
    return np.column_stack(made), base_names + [f"{n}_lag{k}" for k in range(1, lags + 1) for n in base_names]


def window_forest(info: dict, series: list[str] | None, trees: int, components: int, lags: int, importance: bool) -> tuple[float, float, dict[str, float]]:
    """Forecast, out-of-bag error and importances of the window's forest on ``series`` (all where None)."""
    key = "features", components, lags, None if series is None else tuple(series)
    if key not in info["shared"]:
        at = list(range(len(info["names"]))) if series is None else [info["names"].index(s) for s in series]
        x, names = lagged(info["history"][:, at], [info["names"][i] for i in at], components, lags)
        info["shared"][key] = K.binned(x, known=len(x) - 1), names
    bins, names = info["shared"][key]
    y = info["y"][lags + info["h"] :]  # labels of all rows but the last h, which have none yet
    if len(y) < 2:
        return float("nan"), float("nan"), {}
    known, seed = bins[: len(y)], _seed(info)
    forest = K.grow(known, y, trees, seed)
    found = dict(zip(names, map(float, forest.importance(known, y, seed)))) if importance else {}
    return float(forest.predict(bins[-1:])[0]), forest.unseen_error(known, y), found


@L.model("random_forest")
def _(x, y, now, info, trees: int = 100, components: int = 4, lags: int = 4, importance: bool = False) -> L.Fitted:
    return window_forest(info, None, trees, components, lags, importance)


@L.model("preselected_forest")
def _(x, y, now, info, trees: int = 100, components: int = 4, lags: int = 4, importance: bool = False) -> L.Fitted:
    """On the target and the series selected for the window (``info["given"]``: window -> series)."""
    chosen = set(info["given"].get(info["window"], ())) | {info["target"]}
    return window_forest(info, [n for n in info["names"] if n in chosen], trees, components, lags, importance)


def preselected_work(selection: DataFrame, chunk: int = L.CHUNK) -> DataFrame:
    """The work of ``selection(panel_id, target, h, window_id, series)``, with the series of each window as ``given``."""
    one = selection.groupBy("panel_id", "target", "h", "window_id").agg(F.collect_set("series").alias("series"))
    at = F.floor((F.col("window_id") - 1) / chunk).cast("int").alias("chunk")
    return one.groupBy("panel_id", "target", "h", at).agg(F.map_from_entries(F.collect_list(F.struct("window_id", "series"))).alias("given"))


def preselected_forecast(obs: DataFrame, selection: DataFrame, m: int, **options) -> DataFrame:
    """Forecasts of the windows of ``selection`` by forests on the target and the series selected there, their components and lags.

    A window without a row in ``selection`` isn't forecast; names that the panel lacks count as none.
    """
    return L.forecast(obs, preselected_work(selection), m, "preselected_forest", **options)


def _groups(names: list[str], group_of: Callable[[str], str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for j, name in enumerate(names):
        out.setdefault(group_of(name), []).append(j)
    return out


def _importance(x: np.ndarray, y: np.ndarray, info: dict, at: list[int], trees: int, seed: int) -> np.ndarray:
    if "bins" not in info["shared"]:
        info["shared"]["bins"] = K.binned(x)
    bins = info["shared"]["bins"][:, at]
    return K.grow(bins, y, trees, seed).importance(bins, y, seed)


def _row(method: str, info: dict, j: int, value: float, turn: int | None) -> dict:
    return {"method": method, "ic": "importance", "series": info["names"][j], "coef": float(value), "round": turn}


def select_one_per_group(obs: DataFrame, work: DataFrame, m: int, group_of: Callable[[str], str], trees: int = 50) -> DataFrame:
    """Of each group the series with the greatest out-of-bag importance in a forest on that group, for every window of ``work``; ``coef`` is the importance."""

    def each(x, y, now, info) -> Iterator[dict]:
        for k, (_, members) in enumerate(sorted(_groups(info["names"], group_of).items())):
            found = _importance(x, y, info, members, trees, _seed(info, k))
            yield _row("one_per_group_rf", info, members[int(found.argmax())], found.max(), None)

    return L.on_windows(obs, work, m, SELECTION, each)


def select_recursive(obs: DataFrame, work: DataFrame, m: int, group_of: Callable[[str], str], trees: int = 50) -> DataFrame:
    """Round by round the series with the greatest out-of-bag importance; its whole group leaves before the next, until none is left."""

    def each(x, y, now, info) -> Iterator[dict]:
        left, turn = _groups(info["names"], group_of), 0
        while left:
            at = sorted(j for members in left.values() for j in members)
            found = _importance(x, y, info, at, trees, _seed(info, turn))
            best, turn = at[int(found.argmax())], turn + 1
            yield _row("recursive_rf", info, best, found.max(), turn)
            del left[group_of(info["names"][best])]

    return L.on_windows(obs, work, m, SELECTION, each)
