"""Autoregressions of every series and window from rolling moments.

One sort of a series gives its lags, and running sums of their products; a window's sums are the difference of two of
them.  So no panel is gathered, a row isn't copied to the windows it belongs to, and what reaches Python are the
few sums of a window, thousands of windows a batch, solved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import KEYS, by_date, whole
from ..sources.io import cut
from .features import up_to
from .linear import FORECAST
from .spread import tasks

NEAR = 24  # values are taken less the mean of so many first ones, against cancellation


def window_moments(obs: DataFrame, h: int, m: int, most: int, step: int, least: int = 24) -> DataFrame:
    """``panel_id, series, window_id, origin_ds, target_ds, y_true, near, rows, now, sums``: a row for each window of each series.

    ``sums`` are those of the products of (1, y[t], ..., y[t - most + 1], y[t + step]), the upper triangle by rows, over the
    window's rows that have all of them and whose labels are known at the origin; ``now`` has the values at the origin and before.
    Window w = 1..m has rows w to T - m + w - h.  Series with gaps are left out, and windows of fewer than ``least`` pairs.
    """
    order = by_date()
    seen = obs.select(*KEYS, "ds", "value", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(whole()).alias("t"), F.count("value").over(whole()).alias("known"))
    seen = seen.where("known = t").withColumn("near", F.avg(F.when(F.col("i") < NEAR, F.col("value"))).over(whole()))
    y = F.col("value") - F.col("near")
    seen = seen.withColumn("y", y)
    names = ["one", *[f"y{k}" for k in range(most)], "label"]
    seen = seen.withColumns({"one": F.lit(1.0)} | {f"y{k}": F.lag("y", k).over(order) for k in range(most)} | {"label": F.lead("y", step).over(order)})
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    whole_row = F.col("label").isNotNull() & F.col(f"y{most - 1}").isNotNull()
    sums = F.array(*[F.sum(F.when(whole_row, F.col(a) * F.col(b)).otherwise(0.0)).over(up_to()) for a, b in pairs])
    ahead = F.array(*[F.lead("y", step - k).over(order) if step > k else F.lag("y", k - step).over(order) for k in range(most)])
    there = {"origin_ds": F.lead("ds", step).over(order), "target_ds": F.lead("ds", step + h).over(order), "y_true": F.lead("value", step + h).over(order)}
    made = seen.select(*KEYS, "i", "t", "near", sums.alias("sums"), ahead.alias("now"), *[v.alias(k) for k, v in there.items()])
    made = cut(made, "moments")  # both ends of a window are read from it
    # the last pair of window tt ends at i = t - m + tt - h - step, its first begins at tt + most - 1
    ends = made.withColumn("tt", F.col("i") - F.col("t") + m + h + step).where(F.col("tt").between(0, m - 1) & (F.col("i") + step - h - F.col("tt") + 1 >= least))
    ends = ends.withColumn("before", F.col("tt") + most - 2)
    starts = made.select(*KEYS, F.col("i").alias("before"), F.col("sums").alias("sums0"))
    both = ends.join(starts, [*KEYS, "before"], "left")
    less = F.when(F.col("sums0").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "sums0", lambda a, b: a - b))
    rows = (F.col("i") - F.col("before")).cast("int").alias("rows")
    return both.select(*KEYS, (F.col("tt") + 1).cast("int").alias("window_id"), "origin_ds", "target_ds", "y_true", "near", rows, "now", less.alias("sums"))


def ar_forecasts(obs: DataFrame, horizons: list[int], m: int, most: int = 6, ic: str = "bic", iterated: bool = False) -> DataFrame:
    """Forecast rows of every series of ``obs`` by autoregressions of 1 to ``most`` lags, the order by criterion on equal rows.

    Direct ones regress the value ``h`` steps later; iterated ones that of the next step, which is then repeated.
    The results are those of the models ``arp_direct`` and ``arp_iterated``.
    """
    obs, out = cut(obs.select(*KEYS, "ds", "value"), "series"), None
    for h in horizons:
        rows = _solved(window_moments(obs, h, m, most, 1 if iterated else h), h, most, ic, iterated)
        out = rows if out is None else out.unionByName(rows)
    return out


def _solved(moments: DataFrame, h: int, most: int, ic: str, iterated: bool) -> DataFrame:
    k, name = most + 2, "arp_iterated" if iterated else "arp_direct"
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            n, sums = c["rows"].to_numpy(), np.array(c["sums"].to_pylist(), float).reshape(batch.num_rows, len(upper))
            now = np.array(c["now"].to_pylist(), float).reshape(batch.num_rows, most)
            mm = np.zeros((batch.num_rows, k, k))
            for q, (i, j) in enumerate(upper):
                mm[:, i, j] = mm[:, j, i] = sums[:, q]
            pred, mse = best_orders(mm, n, now, h, most, ic, iterated)
            good = np.isfinite(pred)
            pred, truth = pred + c["near"].to_numpy(), c["y_true"].to_numpy()
            cols = [
                c["panel_id"], pa.array([name] * batch.num_rows), c["series"], pa.array([h] * batch.num_rows, pa.int32()), c["window_id"], c["origin_ds"], c["target_ds"],
                c["y_true"], pa.array(pred, from_pandas=True), pa.array(truth - pred, from_pandas=True), pa.array(mse, from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in FORECAST.split(", ")]).filter(pa.array(good))

    return moments.repartition(tasks(moments)).mapInArrow(each, FORECAST)


def best_orders(products: np.ndarray, n: np.ndarray, now: np.ndarray, h: int, most: int, ic: str, iterated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and mean squared residuals of many windows at once; NaN where no order has enough rows."""
    size = len(n)
    best, pred, mse = np.full(size, np.inf), np.full(size, np.nan), np.full(size, np.nan)
    yy = products[:, -1, -1]
    for p in range(1, most + 1):
        xx, xy = products[:, : p + 1, : p + 1], products[:, : p + 1, -1]
        scale = np.sqrt(np.maximum(np.einsum("sii->si", xx), 1e-300))
        inverse = np.linalg.pinv(xx / scale[:, :, None] / scale[:, None, :], rcond=1e-13, hermitian=True) if size else xx
        b = np.einsum("sij,sj->si", inverse, xy / scale) / scale
        ssr = np.maximum(yy - np.einsum("si,si->s", b, xy), 0.0)
        safe = np.maximum(n, 3)
        cost = {"aic": 2.0, "bic": np.log(safe), "hq": 2 * np.log(np.log(safe))}[ic]
        score = np.where(n > p + 2, np.log(np.maximum(ssr, 1e-300) / safe) + (p + 1) * cost / safe, np.inf)
        better = score < best - 1e-12
        state = now[:, :p]
        for _ in range(h if iterated else 1):
            value = b[:, 0] + np.einsum("si,si->s", b[:, 1:], state)
            state = np.column_stack([value, state[:, :-1]])
        best, pred, mse = np.where(better, score, best), np.where(better, value, pred), np.where(better, ssr / safe, mse)
    return pred, mse
