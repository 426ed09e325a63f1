"""Toxic passages by maximum-scoring segments.

Every token has a score: the log-odds of toxic against other training documents under a
Dirichlet prior, less a constant, so that ordinary text scores below zero.  A linear scan
finds all maximal scoring segments of a text.  The scores of chance segments follow an
extreme-value law: with n tokens, P(best >= S) = 1 - exp(-K n exp(-lambda S)).  lambda comes
from the score distribution of clean text and K from the best segments of clean training
documents.  A segment's value is x = lambda S - ln(K n), the negative logarithm of the number
of such segments expected by chance.  A document's statistic joins all its segments that chance
would give less than once: the sum statistic of Karlin and Altschul (1993) of the r best of
them, for the r that is least probable.  A logistic curve over training documents makes a
probability of it.

Words that training saw too rarely take the score of their longest known prefix.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

WORD = re.compile(r"[^\W_]+")
PREFIXES = (6, 5, 4)
NEVER, MOST = -12.0, 12.0  # range of the statistic on its curve; the least is that of a text without any positive token
SIGNIFICANT = -math.log(0.01)  # value of a passage that chance gives once in a hundred texts


def fold(doc_id: Column) -> Column:
    """0 to 4; documents in fold 0 are held out of training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in one pass over the positive tokens.

    A stack holds candidate segments with the running totals before and after them; a new
    one is joined to the nearest earlier one that starts lower, unless that one ends higher.
    """
    where = np.flatnonzero(scores > 0)
    after = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    lower: list[int] = []  # for each entry: the nearest entry with a lower total before it, or -1
    for i in where.tolist():
        new = (i, i + 1, float(after[i] - scores[i]), float(after[i]))
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = lower[j]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                lower.append(j)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:], lower[j:]
    return [(s, e, hi - lo) for s, e, lo, hi in stack]


def joint(values: list[float]) -> float:
    """The negative logarithm of the least probability of the r best of ``values``, over r = 1, 2, ...; values of 0 or less only count alone.

    P(sum of the r best >= T) is about exp(-T) T^(r - 1) / (r! (r - 1)!); each further segment is charged a factor of 2.
    """
    best = total = -math.inf
    for r, v in enumerate(sorted(values, reverse=True), 1):
        if r == 1:
            best = total = v
        elif v <= 0:
            break
        else:
            total += v
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


class _Scores(dict):
    """Word -> score; words met before are kept until the table is full."""

    def __init__(self, known: dict[str, float], limit: int = 300_000):
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> float:
        low = word.lower()
        found = self.known.get(low)
        for n in PREFIXES:
            if found is not None:
                break
            if len(low) >= n:
                found = self.known.get(f"{low[:n]}*")
        out = found or 0.0
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


@dataclass
class ToxicityModel:
    known: dict[str, float]
    cost: float
    lam: float
    k: float = 1.0
    a: float = 0.0
    b: float = 1.0
    _scores: _Scores | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_scores": None}

    def odds(self, text: str | None) -> np.ndarray:
        """Log-odds of the words of a text."""
        if self._scores is None:
            self._scores = _Scores(self.known)
        words = WORD.findall(text or "")
        return np.fromiter(map(self._scores.__getitem__, words), np.float64, len(words))

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments ``(first word, end word, score)`` and the number of words."""
        odds = self.odds(text)
        return (segments(odds - self.cost), len(odds)) if len(odds) else ([], 0)

    def normal(self, score: float, n: int) -> float:
        return self.lam * score - math.log(self.k * n)

    def statistic(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The joint value of all segments, and the significant ones ``(first word, end word, value)``."""
        found, n = self.passages(text)
        valued = [(s, e, self.normal(x, n)) for s, e, x in found]
        return min(MOST, max(NEVER, joint([v for _, _, v in valued]))), [x for x in valued if x[2] > SIGNIFICANT]

    def spans(self, text: str | None, passages: list[tuple[int, int, float]]) -> list[dict]:
        """Passages as ``start, end`` in code points and their value."""
        if not passages:
            return []
        words = [m.span() for m in WORD.finditer(text or "")]
        return [{"start": words[s][0], "end": words[e - 1][1], "value": v} for s, e, v in passages]

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a + self.b * max(statistic, NEVER)))))


def training_set(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic, tries`` of at most ``most`` labelled documents outside fold 0, chosen by a hash of the id; a third of them are ``tries``."""
    usable = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most ``most`` pairs of an id and a label are broadcast, so the texts of the corpus are only filtered
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("tries"))


def _features(text: str | None) -> Counter:
    found = Counter(w.lower() for w in WORD.findall(text or ""))
    for w, n in list(found.items()):
        for k in PREFIXES:
            if len(w) >= k:
                found[f"{w[:k]}*"] += n
    return found


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_training: int = 20_000,
    least_docs: int = 5,
    prior: float = 1.0,
    least_z: float = 3.5,
    costs: tuple[float, ...] = (0.02, 0.05, 0.1, 0.25, 0.5),
) -> ToxicityModel:
    """Learns from a bounded sample: ``max_training`` labelled documents, which bounds their words and prefixes, too.

    Log-odds compare the rates of a feature among all tokens of toxic and of other documents.  Features
    in fewer than ``least_docs`` documents are unknown; those whose document counts lie within ``least_z``
    standard errors of the base rate count as zero.  K, the logistic curve and the cost per token, that of ``costs`` with
    the least logistic loss, are fitted on a third of the sample with counts of the other two thirds; then the counts
    of the whole sample are used.  A sample with few toxic or few other documents serves for both.
    """
    sample = cut(training_set(docs, labels, max_training), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, tries in zip(*(c.to_pylist() for c in batch.columns)):
                side = 1 if toxic else 0
                for f, n in _features(text).items():
                    row = held.setdefault(f, [0] * 8)
                    for first in (0,) if tries else (0, 4):  # of all, and of those that don't fit the curve
                        row[first + side] += n
                        row[first + 2 + side] += 1
                if len(held) > 300_000:
                    yield from out(held)
                    held = {}
        yield from out(held)

    def out(held) -> Iterator[pa.RecordBatch]:
        names = list(held)
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            columns = [pa.array([held[f][k] for f in part], pa.int64()) for k in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *columns], ["f", *_COUNTS])

    counts = sample.mapInArrow(count, "f string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("f").agg(*[F.sum(x).alias(x) for x in _COUNTS])
    counts = cut(counts, "toxicity-counts")
    word = ~F.col("f").endswith("*")
    tokens = counts.where(word).agg(*[F.sum(c) for c in ("nc", "nt", "nc0", "nt0")]).first()
    kept = counts.where(F.col("c") + F.col("t") >= least_docs).collect()  # bounded by the sample
    learn = ~F.col("tries")
    sizes = sample.agg(F.count_if(F.col("toxic") == 1), F.count(F.lit(1)), F.count_if(learn & (F.col("toxic") == 1)), F.count_if(learn)).first()
    n_toxic, n_all, some_toxic, some = (x or 0 for x in sizes)
    if not n_toxic or n_toxic == n_all or not all(tokens[:2]):  # nothing to learn from: the base rate alone
        base = (n_toxic + 0.5) / (n_all + 1)
        return ToxicityModel({}, costs[0], 1.0, a=math.log(base / (1 - base)), b=0.0)

    def built(first: int, n_toxic: int, n_all: int) -> list[ToxicityModel]:
        base, share = n_toxic / n_all, tokens[first // 2 + 1] / (tokens[first // 2] + tokens[first // 2 + 1])
        known, weight = {}, Counter()
        for f, *both in kept:
            nc, nt, c, t = both[first : first + 4]
            if c + t < least_docs:
                continue
            up, down = t + prior * base, c + prior * (1 - base)
            z = (math.log(up / down) - math.log(base / (1 - base))) / math.sqrt(1 / up + 1 / down)
            odds = math.log((nt + prior * share) / (nc + prior * (1 - share))) - math.log(share / (1 - share))
            known[f] = odds if abs(z) >= least_z else 0.0
            if not f.endswith("*"):
                weight[known[f]] += nc + prior * (1 - share)
        weight[0.0] += max(0.0, tokens[first // 2] - sum(weight.values()))
        return [ToxicityModel(known, x, _lambda(weight, x)) for x in costs]

    whole, tried_toxic = built(0, n_toxic, n_all), n_toxic - some_toxic
    if min(some_toxic, some - some_toxic, tried_toxic, n_all - some - tried_toxic) < LEAST_OF_A_KIND or not all(tokens[2:]):
        return _calibrate(whole, sample)
    fitted = _calibrate(built(4, some_toxic, some), sample.where("tries"))
    model = next(m for m in whole if m.cost == fitted.cost)
    model.k, model.a, model.b = fitted.k, fitted.a, fitted.b
    return model


_COUNTS = ("nc", "nt", "c", "t", "nc0", "nt0", "c0", "t0")
LEAST_OF_A_KIND = 20  # toxic and other documents on either side that are needed to fit the curve on texts the counts never saw


def _lambda(weight: Counter, cost: float) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1 over the scores of clean text."""
    s = np.array(list(weight)) - cost
    p = np.array(list(weight.values()))
    p = p / p.sum() if p.sum() else p
    if not (s > 0).any():
        return 1.0
    over = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) > 1
    low, high = 0.0, 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(high, 1e-2)


def _calibrate(models: list[ToxicityModel], sample: DataFrame) -> ToxicityModel:
    """For each model K by maximum likelihood over clean documents of the sample, then the logistic curve of best segments.

    The model with the least loss gets its curve anew from the joint statistic.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns[:2])
            rows = []
            for text in texts:
                odds = models[0].odds(text)
                tops = [max((x for _, _, x in segments(odds - m.cost)), default=None) if len(odds) else None for m in models]
                rows.append([None if top is None else m.lam * top - math.log(len(odds)) for m, top in zip(models, tops)])
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "y": [int(v) for v in toxic]})

    found = sample.mapInArrow(best, "x array<double>, y long").collect()  # a few numbers for each of the bounded sample
    y = np.array([r.y for r in found], float)
    fitted = []
    for i, model in enumerate(models):
        raw = np.array([np.nan if r.x[i] is None else r.x[i] for r in found])
        # the law has P(x <= v) = exp(-K exp(-v)), whose likelihood is greatest at K = count / sum of exp(-x)
        clean = raw[(y == 0) & ~np.isnan(raw)]
        if len(clean) >= 20:
            model.k = float(len(clean) / np.exp(-clean).sum())
        x = np.clip(np.nan_to_num(raw - math.log(model.k), nan=NEVER), NEVER, MOST)
        fitted.append((_logistic(model, x, y), i))
    model = models[min(fitted)[1]]

    def joint_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns[:2])
            yield pa.RecordBatch.from_pydict({"x": pa.array([model.statistic(t)[0] for t in texts], pa.float64()), "y": [int(v) for v in toxic]})

    found = sample.mapInArrow(joint_of, "x double, y long").collect()  # two numbers for each of the bounded sample
    _logistic(model, np.array([r.x for r in found]), np.array([r.y for r in found], float))
    return model


def _logistic(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> float:
    """Sets the curve by Newton steps with a weak pull to a slope; returns its mean loss."""
    z = np.column_stack([np.ones_like(x), x / 10])
    w, pull, rest = np.array([0.0, 1.0]), np.diag([1e-3, 1e-1]), np.array([0.0, 1.0])
    prob = lambda: 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
    for _ in range(50):
        q = prob()
        step = np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + pull, z.T @ (y - q) - pull @ (w - rest))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.a, model.b = float(w[0]), float(w[1] / 10)
    q = np.clip(prob(), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, score, n_passages`` and, with ``keep``, ``passages``: a row for each row of ``docs``.

    ``passages`` are the significant ones as ``(start, end, value)``, in code points.  Null, empty and
    wordless texts have the probability of a text without any toxic token.  Null ids and repeated rows
    are scored like others; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                found = [m.statistic(t) for t in texts]
                cols = [part.column(0), pa.array([m.probability(x) for x, _ in found]), pa.array([len(p) for _, p in found], pa.int64())]
                if keep:
                    cols.append(pa.array([m.spans(t, p) for t, (_, p) in zip(texts, found)], pa.list_(_SPAN)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_passages", "passages"][: len(cols)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])
    if keep:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.DoubleType())])
        kind.add("passages", T.ArrayType(span))
    return rows.mapInArrow(each, kind)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64())])


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(text_col)
            yield batch.filter(pa.array([m.probability(m.statistic(t.as_py())[0]) < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
