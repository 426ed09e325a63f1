"""Forecasts and selections on rolling windows by small regressions.

One task holds the matrix of one panel for a share of its targets and a chunk of windows, which keeps
a large panel from landing in one task.  A window uses labels up to its origin only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import factors as KF
from ..kernels import linear as KL
from ..kernels.gram import Pairs, Run, run_of
from ..sources.io import cut, table_exists
from .spread import dealt, each_series

FORECAST = "panel_id string, model string, target string, h int, window_id int, origin_ds date, target_ds date, y_true double, y_pred double, err double, in_sample double"
CHUNK = 4  # windows of a group
SELECTION = "panel_id string, target string, h int, method string, ic string, window_id int, series string, coef double, lambda double, lambda_idx int"


def lambda_grid(obs: DataFrame, targets: list[str] | None = None, alpha: float = 1.0, steps: int = 200) -> DataFrame:
    """``panel_id, target, idx, lambda``: linear penalties from max |X'y| / (n alpha) over the panel's standardised other series down to 1e-4 of it.

    A series with y at some dates only is standardised over these.  Every series is a target where ``targets`` is None.
    Pairs of series come from a join by panel and date; they are N^2 numbers a date, summed where they are made.
    """
    y = obs.select("panel_id", "ds", F.col("series").alias("target"), F.col("value").alias("y")).where("y is not null")
    y = y if targets is None else y.where(F.col("target").isin(targets))
    x = obs.where("value is not null").select("panel_id", "ds", "series", "value").join(y, ["panel_id", "ds"]).where("series <> target")
    sums = x.groupBy("panel_id", "target", "series").agg(F.count(F.lit(1)).alias("n"), F.regr_sxy("y", "value").alias("sxy"), F.regr_sxx("y", "value").alias("sxx"))
    each = F.abs(F.try_divide("sxy", F.sqrt(F.try_divide(F.col("sxx"), F.col("n") - 1)))) / F.col("n")
    top = sums.groupBy("panel_id", "target").agg((F.max(each) / alpha).alias("top"))
    i = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return top.select("panel_id", "target", "top", i.alias("idx")).select("panel_id", "target", F.col("idx").cast("long").alias("idx"), (F.col("top") * (1 - F.col("idx") * (1 - 1e-4) / (steps - 1))).alias("lambda"))


def work_list(obs: DataFrame, targets: list[str] | None, horizons: list[int], m: int, chunk: int = CHUNK) -> DataFrame:
    """``panel_id, target, h, chunk``: what is to be done; every series is a target where ``targets`` is None."""
    if targets is None:
        grid = obs.select("panel_id", F.col("series").alias("target")).distinct()
    else:
        grid = obs.select("panel_id").distinct().select("panel_id", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    return grid.select("*", F.explode(F.sequence(F.lit(0), F.lit((m - 1) // chunk))).alias("chunk"))


def on_windows(obs: DataFrame, work: DataFrame, m: int, schema: str, each: Callable, chunk: int = CHUNK, least: int = 24, parts: int = 2, expanding: bool = False) -> DataFrame:
    """Runs ``each(x, y, x_now, info)`` for every window of all of ``work``.

    ``x``, ``y`` are the training pairs (x[s], y[s+h]) with labels up to the origin, ``x_now`` the row
    at the origin; ``info`` has names, dates, history and keys, ``run``, the window's products from the panel's
    prefix sums, and ``shared``, a dict that all targets of one window and horizon have in common.
    Series with gaps are left out.  Where ``work`` has a column ``given``, a map with windows for keys, it is handed on in
    ``info`` and only its windows are run.  With ``expanding`` every window begins with the panel's first row.

    A group has one chunk of windows and one of ``parts`` shares of a panel's targets, at all horizons,
    so a panel is shipped once for each chunk and share, whatever the number of targets and horizons.  Groups are
    small in bytes and long in work, so they are dealt over a given number of tasks.
    """
    key = ["panel_id", "chunk", "part"]
    todo = work.withColumn("part", F.pmod(F.xxhash64("target"), F.lit(parts)).cast("int"))
    dealt_rows = obs.select("panel_id", "series", "ds", "value").join(todo.select(*key).distinct(), "panel_id")
    columns = [c.split()[0] for c in schema.split(", ")]

    def task(pdf: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        if not len(pdf) or not len(todo):
            return pd.DataFrame(rows, columns=columns)
        panel, part = todo["of"].iat[0], int(todo["at"].iat[0])
        wide = pdf.pivot(index="ds", columns="series", values="value").sort_index()
        wide = wide.loc[:, wide.notna().all()]
        values, t, names = wide.to_numpy(float), len(wide), list(wide.columns)
        place = {n: i for i, n in enumerate(names)}
        by_h = {int(h): sorted(set(g["target"]) & place.keys()) for h, g in todo.groupby("h")}
        given = {(int(h), n): {int(w): list(v) for w, v in dict(g).items()} for h, n, g in zip(todo["h"], todo["target"], todo["given"])} if "given" in todo else None
        for h, targets in sorted(by_h.items()):
            pairs = Pairs(values[: t - h], values[h:], least) if targets and t - h > least else None
            for tt in range(part * chunk, min(m, (part + 1) * chunk)):
                now, first = t - m + tt - h, 0 if expanding else tt  # the origin, whose label is row now + h; the first row
                if pairs is None or now - h - first + 1 < least:
                    continue
                pairs.forget()
                s = np.arange(first, now - h + 1)
                common = {"names": names, "history": values[first : now + 1], "h": h, "window": tt + 1, "shared": {}}
                for target in targets:
                    if given is not None and tt + 1 not in given[h, target]:
                        continue
                    y = values[:, place[target]]
                    base = {"panel_id": panel, "target": target, "h": h, "window_id": tt + 1}
                    info = common | {"y": y[first : now + 1], "target": target, "run": Run(pairs, first, now - h + 1, place[target]), "given": given and given[h, target]}
                    for row in each(values[s], y[s + h], values[now], info):
                        if "y_pred" in row:
                            row |= {"origin_ds": wide.index[now], "target_ds": wide.index[now + h], "y_true": y[now + h], "err": y[now + h] - row["y_pred"]}
                        rows.append(base | row)
        return pd.DataFrame(rows, columns=columns)

    other = todo.select(F.col("panel_id").alias("of"), F.col("chunk").alias("at"), F.col("part").alias("share"), "target", "h", *(["given"] if "given" in work.columns else []))
    left, right = dealt(dealt_rows, *key), dealt(other, "of", "at", "share")
    return left.groupBy(*key).cogroup(right.groupBy("of", "at", "share")).applyInPandas(task, schema)


Fitted = tuple[float, float | None, dict[str, float]]
MODELS: dict[str, Callable[..., Fitted]] = {}


def model(name: str) -> Callable:
    """Registers ``fit_predict(x, y, now, info, **options) -> (prediction, in-sample mean squared error, importances)``."""

    def put(f: Callable[..., Fitted]) -> Callable[..., Fitted]:
        MODELS[name] = f
        return f

    return put


@model("arp_direct")
def _(x, y, now, info, **options) -> Fitted:
    value, _, _, mse = KL.ar_direct(info["y"], info["h"], **options)
    return value, mse, {}


@model("arp_iterated")
def _(x, y, now, info, **options) -> Fitted:
    value, _, _, mse = KL.ar_iterated(info["y"], info["h"], **options)
    return value, mse, {}


def _window_factors(info: dict, r: int) -> np.ndarray:
    if ("factors", r) not in info["shared"]:
        mean, sd = KL.scale(info["history"])
        info["shared"]["factors", r] = KF.static_factors((info["history"] - mean) / sd, r)[1]
    return info["shared"]["factors", r]


@model("ar_factor")
def _(x, y, now, info, r: int = 2, most: int = 3, factor_lags: int = 2, ic: str = "bic") -> Fitted:
    value, _, _, mse = KL.ar_direct(info["y"], info["h"], most, ic, _window_factors(info, r), factor_lags)
    return value, mse, {}


@model("ar_factor_iterated")
def _(x, y, now, info, r: int = 2, most: int = 3, factor_lags: int = 2, ic: str = "bic") -> Fitted:
    value, _, _, mse = KL.ar_iterated(info["y"], info["h"], most, ic, _window_factors(info, r), factor_lags)
    return value, mse, {}


@model("state")
def _(x, y, now, info, r: int = 2, p: int = 1, q: int | None = None) -> Fitted:
    if ("state", r, p, q) not in info["shared"]:
        info["shared"]["state", r, p, q] = KF.state_forecast(KF.two_step(info["history"], r, p, q), info["h"])
    return float(info["shared"]["state", r, p, q][info["names"].index(info["target"])]), None, {}


def _penalised(method: str, alpha: float) -> Callable[..., Fitted]:
    def fit_predict(x, y, now, info, **options) -> Fitted:
        fit = KL.penalised(x, y, info["h"], method, alpha, run=info["run"], **options)
        return float(KL.predict(fit, now)), fit["mse"], dict(zip(info["names"], map(float, fit["coef"])))

    return fit_predict


for _name, _method, _alpha in (("lasso", "lasso", 1.0), ("elastic_net", "lasso", 0.5), ("ridge", "ridge", 1.0), ("adaptive_lasso", "adaptive", 1.0)):
    model(_name)(_penalised(_method, _alpha))


def forecast(obs: DataFrame, work: DataFrame, m: int, model: str | Callable[..., Fitted], name: str | None = None, **options) -> DataFrame:
    """Forecast rows of one model, a name of ``MODELS`` or a function of that protocol; ``in_sample`` is its mean squared error in training."""
    fit_predict = MODELS[model] if isinstance(model, str) else model
    label = name or (model if isinstance(model, str) else model.__name__)

    def each(x, y, now, info):
        value, mse, _ = fit_predict(x, y, now, info, **options)
        yield {"model": label, "y_pred": value, "in_sample": mse}

    return on_windows(obs, work, m, FORECAST, each)


def importances(obs: DataFrame, work: DataFrame, m: int, model: str | Callable[..., Fitted], **options) -> DataFrame:
    """``feature, importance`` of each window's fit, as the model reports them (coefficients of standardised series); zeros are left out."""
    fit_predict = MODELS[model] if isinstance(model, str) else model
    label = model if isinstance(model, str) else model.__name__

    def each(x, y, now, info):
        for feature, value in fit_predict(x, y, now, info, **options)[2].items():
            if value:
                yield {"model": label, "feature": feature, "importance": value}

    return on_windows(obs, work, m, "panel_id string, model string, target string, h int, window_id int, feature string, importance double", each)


def select_penalised(obs: DataFrame, work: DataFrame, m: int, alpha: float = 1.0, ic: str = "bic", **options) -> DataFrame:
    """Selected series of each window as sparse rows."""

    def each(x, y, now, info):
        fit = KL.penalised(x, y, info["h"], "lasso", alpha, ic, run=info["run"], **options)
        for j in np.flatnonzero(fit["coef"]):
            yield {"method": f"alpha{alpha}", "ic": ic, "series": info["names"][j], "coef": float(fit["coef"][j]), "lambda": fit["lambda"], "lambda_idx": fit["idx"]}

    return on_windows(obs, work, m, SELECTION, each)


def lambda_choice(obs: DataFrame, work: DataFrame, m: int, alpha: float = 1.0, ic: str = "cv", **options) -> DataFrame:
    """The penalty chosen for each window and how many series it keeps."""

    def each(x, y, now, info):
        fit = KL.penalised(x, y, info["h"], "lasso", alpha, ic, run=info["run"], **options)
        yield {"ic": ic, "lambda": fit["lambda"], "lambda_idx": fit["idx"], "n_selected": int((fit["coef"] != 0).sum())}

    return on_windows(obs, work, m, "panel_id string, target string, h int, ic string, window_id int, lambda double, lambda_idx int, n_selected int", each)


def select_one_per_group(obs: DataFrame, work: DataFrame, m: int, group_of: Callable[[str], str], steps: int = 50) -> DataFrame:
    """One series of each group: the first penalty with exactly one series, else the largest coefficient of the sparsest non-empty one."""

    def each(x, y, now, info):
        groups: dict[str, list[int]] = {}
        for j, name in enumerate(info["names"]):
            groups.setdefault(group_of(name), []).append(j)
        for members in groups.values():
            run, n = info["run"], len(y)
            xy = run.xy[members]
            lambdas = KL.penalties(xy, n, 1.0, steps)
            path = KL.lasso_path(run.gram[np.ix_(members, members)] / n, xy / n, lambdas)
            count = (path != 0).sum(axis=1)
            some = np.flatnonzero(count > 0)
            if len(some):
                single = np.flatnonzero(count == 1)
                i = int(single[0] if len(single) else some[count[some].argmin()])
                j = int(np.abs(path[i]).argmax())
                yield {"method": "one_per_group", "ic": "path", "series": info["names"][members[j]], "coef": float(path[i, j]), "lambda": float(lambdas[i]), "lambda_idx": i}

    return on_windows(obs, work, m, SELECTION, each)


def random_candidates(n: int, lags: tuple[int, int] = (1, 12), lam: tuple[float, float] = (1e-3, 1e3), seed: int = 1) -> list[dict]:
    """``n`` seeded points of the box: lags uniform, penalties uniform in their logarithm."""
    rng = np.random.default_rng(seed)
    p = rng.integers(lags[0], lags[1] + 1, n)
    x = np.exp(rng.uniform(np.log(lam[0]), np.log(lam[1]), n))
    return [{"lags": int(a), "lambda": float(b)} for a, b in zip(p, x)]


def hyperparameter_search(obs: DataFrame, targets: list[str] | None, h: int, candidates: list[dict], splits: int = 5) -> DataFrame:
    """Ridge candidates (penalty and lags) scored over expanding splits of each target; the best by mean score, none scored twice.

    A series meets all candidates in one task.
    """
    seen = sorted({(int(c["lags"]), float(c["lambda"])) for c in candidates})
    series = obs.where(F.col("value").isNotNull() & (F.lit(True) if targets is None else F.col("series").isin(targets)))

    def score(y: np.ndarray, p: int, lam: float) -> float | None:
        if len(y) < p + h:
            return None
        x, v, errors = KL.lags(y, p)[p - 1 : len(y) - h], y[p - 1 + h :], []
        size = len(v) // (splits + 1)
        for k in range(splits):
            cut = len(v) - (splits - k) * size
            tr, te = slice(0, max(cut - h + 1, 0)), slice(cut, cut + size)
            if size and tr.stop > p + 2:
                run = run_of(x[tr], v[tr])
                b = KL.ridge_path(run.gram, run.xy, np.array([lam]))
                errors.append(float((run.missed(run_of(x[te], v[te]), b) ** 2).mean()))
        return float(np.mean(errors)) if errors else None

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        y, first = pdf["value"].to_numpy(float), pdf.iloc[0]
        scores = [(s, p, lam) for p, lam in seen if (s := score(y, p, lam)) is not None]
        best = [(first["panel_id"], first["series"], p, lam, s) for s, p, lam in [min(scores, key=lambda c: (c[0], c[1], c[2]))]] if scores else []
        return pd.DataFrame(best, columns=["panel_id", "series", "lags", "lambda", "score"])

    return each_series(series.select("panel_id", "series", "ds", "value"), each, "panel_id string, series string, lags int, lambda double, score double")


def search_models(obs: DataFrame, targets: list[str] | None, horizons: list[int], candidates: list[dict], origins: int = 5, ledger: str | None = None) -> DataFrame:
    """``panel_id, target, h, candidate, score, n, best``: candidates of any registered model scored over expanding windows.

    A candidate is ``{"model": name, **options}``, and its score the mean squared error of the forecasts of the last
    ``origins`` labels, each from a fit on all rows before.  All candidates of a window are fitted in one task, beside each
    other on the same products.  ``ledger`` is a table of scores of this panel table and ``origins``: what is in it isn't
    scored again, and new scores are added to it.  ``best`` marks the least score, the first name on ties.
    """
    spark = obs.sparkSession
    named = {json.dumps(c, sort_keys=True): c for c in candidates}
    keys = ["panel_id", "target", "h"]
    old = spark.read.schema(LEDGER).parquet(ledger) if ledger and table_exists(spark, ledger) else spark.createDataFrame([], LEDGER)
    known = old.groupBy(*keys).agg(F.collect_set("candidate").alias("known"))  # a few names a target
    todo = F.array_except(F.array(*map(F.lit, named)), F.coalesce("known", F.array().cast("array<string>")))
    work = work_list(obs, targets, horizons, origins).join(known, keys, "left").withColumn("todo", todo).where(F.size("todo") > 0)
    windows = F.sequence(F.lit(1), F.lit(origins))
    work = work.select(*keys, "chunk", F.map_from_arrays(windows, F.array_repeat("todo", origins)).alias("given"))

    def each(x, y, now, info):
        for name in info["given"][info["window"]]:
            options = dict(named[name])
            value, _, _ = MODELS[options.pop("model")](x, y, now, info, **options)
            yield {"candidate": name, "y_pred": value}

    errors = on_windows(obs, work, origins, "panel_id string, target string, h int, window_id int, candidate string, err double", each, expanding=True)
    new = errors.where("err is not null and not isnan(err)").groupBy(*keys, "candidate").agg(F.avg(F.col("err") ** 2).alias("score"), F.count(F.lit(1)).cast("int").alias("n"))
    if ledger:
        cut(new, "scores").write.mode("append").parquet(ledger)
        every = spark.read.schema(LEDGER).parquet(ledger)
    else:
        every = new
    order = Window.partitionBy(*keys).orderBy("score", "candidate")
    wanted = every.where(F.col("candidate").isin(*named))
    return wanted.withColumn("best", F.row_number().over(order) == 1)


LEDGER = "panel_id string, target string, h int, candidate string, score double, n int"
