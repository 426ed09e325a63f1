"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table gives every document a posterior over domains.
Nonnegative rates are then fitted so that the expected tokens of each domain, the sum over
documents of rate x tokens x posterior, meet the domain's target: least squares by projected gradient
steps on the rates.  A step lowers each rate by its share of the misses and projects it onto its bounds.
Steps are scaled by the domains x domains products of the documents that are free to move, which a
pass over the documents sums together with the domains' tokens, so nothing else reaches the driver.
"""

from __future__ import annotations

import json
import logging
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, fresh

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
log = logging.getLogger(__name__)


def domain() -> Column:
    """The domain of a row of the labelled table; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


class _Slots(dict):
    """Word -> row of the model's table; words met before are kept until the table is full."""

    def __init__(self, size: int, limit: int = 300_000):
        self.size, self.limit = size, limit

    def __missing__(self, word: str) -> int:
        out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.size
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


@dataclass
class DomainModel:
    """Naive Bayes over hashed words, its mean word log-likelihood scaled by a fitted sharpness."""

    table: np.ndarray  # size x domains: log p(word | domain)
    prior: np.ndarray
    sharp: float = 1.0
    slots: _Slots | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"slots": None}

    def raw(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words and the mean log-likelihood by domain."""
        if self.slots is None:
            self.slots = _Slots(len(self.table))
        words = (text or "").split()
        if not words:
            return 0, np.zeros(len(self.prior))
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        return len(words), self.table[at].mean(axis=0)

    def posterior(self, mean: np.ndarray) -> np.ndarray:
        z = self.prior + self.sharp * mean
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, max_training: int = 20_000, size: int = 1 << 16, domains: tuple[str, ...] = DOMAINS) -> DomainModel:
    """Learns from at most ``max_training`` labelled documents chosen by a hash of the id; a third of them fits the sharpness."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(domain()).alias("domain"))
        .where(F.col("domain").isin(*domains))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_training)
    )
    sample = cut(
        # at most ``max_training`` pairs of an id and a domain are broadcast, so the texts of the corpus are only filtered
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "domain", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("tries")),
        "domain-sample",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots = np.zeros((size, len(domains)), np.int64), _Slots(size)
        for batch in batches:
            for text, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.fromiter(map(slots.__getitem__, set((text or "").split())), np.int64)
                np.add.at(total[:, domains.index(d)], at, 1)
        at, d = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": at, "d": d, "n": total[at, d]})

    rows = sample.where("not tries").select("text", "domain").mapInArrow(count, "slot long, d long, n long")
    counts = np.zeros((size, len(domains)))
    for r in rows.groupBy("slot", "d").agg(F.sum("n").alias("n")).collect():  # at most size x domains numbers
        counts[r.slot, r.d] = r.n
    back = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum() + size)  # words the domain lacks follow all domains together
    table = np.log((counts + 50 * back) / (counts.sum(axis=0, keepdims=True) + 50))
    seen = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    prior = np.log(np.array([seen.get(d, 0) + 0.5 for d in domains]) / (sum(seen.values()) + 0.5 * len(domains)))
    model = DomainModel(table, prior)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"m": pa.array([model.raw(t)[1].tolist() for t in texts], pa.list_(pa.float64())), "domain": batch.column(1)})

    trial = sample.where("tries").select("text", "domain").mapInArrow(means, "m array<double>, domain string").collect()  # a few numbers each
    if trial:
        m, y = np.array([r.m for r in trial]), np.array([domains.index(r.domain) for r in trial])
        loss = {}
        for sharp in 2.0 ** np.arange(0, 9):
            model.sharp = float(sharp)
            loss[float(sharp)] = -np.log(model.posterior(m)[np.arange(len(y)), y] + 1e-12).mean()
        model.sharp = min(loss, key=loss.get)
    return model


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, p``: words between white space, and an array of domain posteriors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size x domains numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [m.raw(t) for t in part.column(1).to_pylist()]
                p = m.posterior(np.array([x for _, x in raw]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in raw], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))],
                    ["doc_id", "n_tokens", "p"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, p array<double>")


def rate(p: Column, steps: list[list[float]], floor: float, most: float | None = None) -> Column:
    """The rate after steps ``rate - p . step`` from 1, each projected onto ``floor`` to ``most``, as one expression."""
    if not steps:
        return F.lit(1.0)
    listed = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    top = F.lit(math.inf if most is None else float(most))
    return F.aggregate(listed, F.lit(1.0), lambda r, s: F.least(top, F.greatest(F.lit(float(floor)), r - dot(s))))


@dataclass(frozen=True)
class Mix:
    steps: list[list[float]]
    floor: float
    targets: list[float]
    reached: list[float]


def fit_rates(members: DataFrame, weights: list[float], floor: float = 0.0, tolerance: float = 1e-5, most_passes: int = 300, most: float | None = None) -> Mix:
    """Fits rates over ``members(n_tokens, p)`` so that expected domain tokens match ``weights``; ``p`` sums to 1.

    With a floor of 0 the domains' tokens are to be shares of all tokens there are.  With a floor above 0 they are
    to be shares of all tokens of the mix, however many these become, so that documents are added and none is
    dropped.  A domain without any mass, or without a weight where there is a floor, is left out.  Rates are from
    ``floor`` to ``most``, or have no ceiling where that is None.

    The squared misses, each over its domain's tokens, are lowered by projected gradient steps from rates of 1:
    ``rate <- clip(rate - p . x)`` with ``x = (G + c H)^-1 miss``, where G sums ``tokens p p'`` over the documents whose
    rate is between its bounds and H has the domains' tokens.  For a great c these are plain gradient steps, for a
    small one they solve for the free rates; c falls to a tenth after each second step in a row and rises tenfold
    where the misses would not fall.  Steps end when every miss is below ``tolerance`` of all tokens, when they gain nothing, which is
    the least-squares answer where targets are out of reach, or after ``most_passes``.  Rates are written to a table
    every ten steps, so a pass repeats ten at most.  Every domain's target and reached tokens are logged, misses of
    more than ten times ``tolerance`` as warnings.
    """
    k, share = len(weights), np.array(weights, float) / sum(weights)
    names = [f"p{i}" for i in range(k)]
    now = members.select(F.col("n_tokens").cast("double").alias("n_tokens"), *[F.col("p")[i].alias(n) for i, n in enumerate(names)], F.lit(1.0).alias("r"))
    steps: list[list[float]] = []
    waiting: list[list[float]] = []

    def stepped(some: list[list[float]]) -> Column:
        """``rate`` from the table's own, written out for a few steps."""
        r = F.col("r")
        for step in some:
            r = F.greatest(F.lit(float(floor)), r - sum((F.col(n) * float(v) for n, v in zip(names[1:], step[1:])), F.col(names[0]) * float(step[0])))
            r = r if most is None else F.least(F.lit(float(most)), r)
        return r

    def at(x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The domains' tokens and the products of free documents after the waiting steps and ``x``."""
        r = stepped([*waiting, *([] if x is None else [x.tolist()])])
        own = now.select("n_tokens", r.alias("r"), *names)
        free = F.when((F.col("r") > floor) & (F.lit(most is None) | (F.col("r") < (most or 0.0))), F.col("n_tokens")).otherwise(0.0)
        row = own.agg(*[F.sum(F.col("n_tokens") * F.col("r") * F.col(a)) for a in names], *[F.sum(free * F.col(a) * F.col(b)) for a in names for b in names]).first()
        sums = np.array([v or 0.0 for v in row])
        return sums[:k], sums[k:].reshape(k, k)

    have, _ = at(None)
    total = have.sum()
    if not total:
        return Mix([], floor, [0.0] * k, [0.0] * k)
    on = np.flatnonzero((have > 0) & (share > 0) if floor else have > 0)
    share = np.where(np.isin(np.arange(k), on), share, 0.0)
    share = share / max(share.sum(), 1e-300) if floor else share
    # misses are linear in the domains' tokens: less the wanted tokens, or less the wanted shares of their own sum
    of = (np.eye(k) - np.outer(share, np.isin(np.arange(k), on)) if floor else np.eye(k))[on]
    want = np.zeros(len(on)) if floor else (share * total)[on]
    weight = np.diag(have[on])
    got, products = at(None)
    miss, pull, eased = of @ got - want, 1e-3, True
    value = (miss**2 / have[on]).sum()
    for _ in range(most_passes):
        if not len(on) or np.abs(miss).max() < tolerance * got.sum() or pull > 1e6:
            break
        x = of.T @ np.linalg.solve(of @ products @ of.T + pull * weight, miss)
        tokens, tried = at(x)
        left = of @ tokens - want
        gain = value - (left**2 / have[on]).sum()
        if gain <= 1e-9 * value:
            pull, eased = pull * 10, False
            continue
        got, products, miss, value = tokens, tried, left, value - gain
        pull, eased = max(pull / 10, 1e-9) if eased else pull, True
        steps.append(x.tolist())
        waiting.append(x.tolist())
        if len(waiting) == 10:
            now = cut(now.select("n_tokens", *names, stepped(waiting).alias("r")), "rates")
            waiting = []
    wanted = share * got[on].sum() if floor else share * total
    for i in on.tolist():
        missed = abs(got[i] - wanted[i]) > 10 * tolerance * got.sum()
        log.log(logging.WARNING if missed else logging.INFO, "mixing domain %d: %.1f tokens wanted, %.1f reached%s", i, wanted[i], got[i], ", target missed" if missed else "")
    return Mix(steps, floor, wanted.tolist(), got.tolist())


def copies(key: Column, rate_: Column) -> Column:
    """A whole number of copies with mean ``rate_``: its floor, and one more for a share of the keys by hash."""
    u = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate_ + u).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 0.0) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies``: a row for each row of ``docs``.

    Null and wordless texts have no tokens and a posterior of the class shares.  Without labelled
    rows all domains are alike.  Null ids and repeated rows are documents of their own (copies of
    rows with one id agree); an empty table gives an empty result; other columns are not read.
    Rates have no ceiling.
    """
    model = fit_domains(docs, labels, domains=tuple(targets))
    members = cut(posteriors(docs, model), "domain-members")
    fitted = fit_rates(members, list(targets.values()), floor, most=None)
    named = members.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(targets)], rate(F.col("p"), fitted.steps, floor, None).alias("rate"))
    return named.withColumn("copies", copies(F.col("doc_id"), F.col("rate")))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 1.0, most: float | None = None) -> DataFrame:
    """``docs``, all columns, each row as often as its rate says; with a floor of 1 every row at least once.

    ``most`` is a ceiling for rates, off where None.  Nulls, repeated rows and empty tables are as in ``mix``.
    """
    model = fit_domains(docs, labels, domains=tuple(targets))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size x domains numbers
    n_col, p_col, nth = (fresh(docs, c) for c in ("n_tokens", "p", "nth"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [m.raw(t) for t in part.column("text").to_pylist()]
                p = m.posterior(np.array([x for _, x in raw]))
                yield part.append_column(n_col, pa.array([n for n, _ in raw], pa.int64())).append_column(p_col, pa.array(p.tolist(), pa.list_(pa.float64())))

    kinds = [T.StructField(n_col, T.LongType()), T.StructField(p_col, T.ArrayType(T.DoubleType()))]
    scored = cut(docs.mapInArrow(each, T.StructType([*docs.schema.fields, *kinds])), "domain-members")  # texts are scored once
    fitted = fit_rates(scored.select(F.col(n_col).alias("n_tokens"), F.col(p_col).alias("p")), list(targets.values()), floor, most=most)
    n = copies(F.col("doc_id"), rate(F.col(p_col), fitted.steps, floor, most)).cast("int")
    return scored.withColumn(nth, F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
