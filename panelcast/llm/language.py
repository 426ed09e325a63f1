"""Language identification by error-correcting output codes.

Every language has a codeword of -1 and +1.  For each bit a binary classifier tells the languages
with +1 from those with -1 by the n-grams of words: the weight of an n-gram is its log-odds between
the two sides, a text's evidence is the sum of the weights over the square root of their number, and
a logistic curve fitted on texts that the counts never saw makes a margin of it.  Decoding is loss-weighted:
a language's loss is the sum over bits of the logistic loss of (its bit x margin), each weighted by how much
better than chance that bit's classifier is for texts of that language.  The language with the least loss is
predicted; a fitted factor turns losses into probabilities.  A text is ambiguous where the margins' signs are
further from the codeword than the code can correct, or the probability is low.

One table of n-gram counts by language serves all bits, so training is one aggregate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .terms import LETTERS, terms
from .toxicity import fold

SIZES = (1, 2, 3, 4)  # lengths of n-grams, in bytes of a word with a mark at both ends
UNKNOWN = "und"  # fixed value: the language of a text without letters


def code(k: int) -> np.ndarray:
    """Codewords of ``k`` languages as rows of -1 and 1.

    Up to six languages the code is exhaustive: every way to part them in two.  For more it is, of 200 dense codes
    of 15 log2 k bits by a fixed generator, the one with the greatest distance between its two closest rows.
    """
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 6:
        parts = np.arange(2 ** (k - 1) - 1)  # the first language is always +1, and not all are
        rows = [np.ones(len(parts), int)] + [np.where(parts >> i & 1, 1, -1) for i in range(k - 1)]
        return np.array(rows, np.int8)
    bits, rng, best = int(np.ceil(15 * np.log2(k))), np.random.default_rng(k), None
    for _ in range(200):
        m = np.where(rng.random((k, bits)) < 0.5, -1, 1)
        m = m[:, np.abs(m.sum(axis=0)) < k]
        apart = (m.shape[1] - m @ m.T) // 2 + np.eye(k, dtype=int) * bits
        if best is None or apart.min() > best[0]:
            best = (int(apart.min()), m)
    return best[1].astype(np.int8)


def grams(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of the n-grams of all words, and each n-gram's word, in order of the words; every word has some."""
    length = np.array([len(w) + 2 for w in words])
    text = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint32)
    of, end = np.repeat(np.arange(len(words)), length), np.repeat(length.cumsum(), length)
    key, slot, word = np.zeros(len(text), np.uint32), [], []
    for n in SIZES:
        last = len(text) - n + 1
        key = key[:last] | text[n - 1 :] << np.uint32(8 * (n - 1))
        whole = np.arange(last) + n <= end[:last]
        hashed = key[whole] * np.uint32(2654435761) + np.uint32(n * 40503)  # multiplicative hashing, modulo 2^32
        slot.append((hashed >> np.uint32(7)) % np.uint32(size))
        word.append(of[:last][whole])
    slot, word = np.concatenate(slot).astype(np.int64), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return slot[order], word[order]


class _Words(dict):
    """Word -> row of sums of its n-grams' weights, and their number; words met first stay, later ones leave after use once there are many."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.limit = int(np.clip((32 << 20) // (8 * (table.shape[1] + 1)), 10_000, 300_000))
        self.rows = np.zeros((0, table.shape[1] + 1))

    def learn(self, words: list[bytes]) -> None:
        slot, word = grams(words, len(self.table))
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.column_stack([np.add.reduceat(self.table[slot], start, axis=0), np.diff(np.r_[start, len(word)])])
        self.update(zip(words, range(len(self), len(self) + len(words))))
        self.rows = np.vstack([self.rows, sums])

    def sums(self, words: list[bytes]) -> np.ndarray:
        """A row for each word."""
        known = len(self)
        new = [w for w in set(words) if w not in self]
        if new:
            self.learn(new)
        out = self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        if new and len(self) > self.limit:
            for w in new:
                del self[w]
            self.rows = self.rows[:known]
        return out


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # languages x bits
    table: np.ndarray  # slots x bits: log-odds of an n-gram
    shift: np.ndarray  # by bit: margin = shift + slope x evidence
    slope: np.ndarray
    weight: np.ndarray  # languages x bits, rows of sum 1
    sharp: float = 1.0
    least: float = 0.9  # probability below which a text is ambiguous
    _words: _Words | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def evidence(self, texts: list[bytes], at_once: int = 50_000) -> np.ndarray:
        """texts x bits: the sum of the weights of all n-grams of a text over the square root of their number; some ``at_once`` words at a time."""
        if self._words is None:
            self._words = _Words(self.table)
        total = np.zeros((len(texts), self.table.shape[1] + 1))
        words: list[bytes] = []
        of: list[int] = []
        sizes: list[int] = []

        def add() -> None:
            if words:
                rows = self._words.sums(words)
                np.add.at(total, of, np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0))
            for waiting in (words, of, sizes):
                waiting.clear()

        for i, text in enumerate(texts):
            for part in terms(text, LETTERS, 1 << 18):
                if part:
                    words.extend(part)
                    of.append(i)
                    sizes.append(len(part))
                if len(words) > at_once:
                    add()
        add()
        return total[:, :-1] / np.sqrt(np.maximum(total[:, -1:], 1.0))

    def losses(self, evidence: np.ndarray) -> np.ndarray:
        """texts x languages, from texts x bits."""
        margin = self.shift + self.slope * evidence
        return np.logaddexp(0, -margin) @ np.where(self.code > 0, self.weight, 0).T + np.logaddexp(0, margin) @ np.where(self.code < 0, self.weight, 0).T

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        z = -self.sharp * self.losses(evidence)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def distance(self, evidence: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Bits in which the signs of the margins differ from the codeword of ``best``."""
        signs = np.where(self.shift + self.slope * evidence > 0, 1, -1)
        return (signs != self.code[best]).sum(axis=1)

    def correctable(self) -> int:
        k, bits = self.code.shape
        if k < 2:
            return 0
        apart = (bits - self.code.astype(int) @ self.code.T.astype(int)) // 2 + np.eye(k, dtype=int) * bits
        return max(0, (int(apart.min()) - 1) // 2)


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Shift and slope of a logistic curve, by Newton steps with a weak pull to (0, 1)."""
    z, w, pull, rest = np.column_stack([np.ones_like(x), x]), np.array([0.0, 1.0]), np.diag([1e-3, 1e-2]), np.array([0.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve(z.T @ (z * (mass * q * (1 - q))[:, None]) + pull, z.T @ (mass * (y - q)) - pull @ (w - rest))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_languages(docs: DataFrame, max_training: int = 20_000, max_languages: int = 100, size: int = 1 << 17, lang_col: str = "lang") -> LanguageModel:
    """Learns from rows with a language whose id is not in fold 0.

    The sample has about ``max_training`` documents at most, an equal share a language, chosen by a hash of the id;
    a third of them fits the curves, weights and the sharpness.  Null texts count as empty.  Of more than ``max_languages`` languages
    the most frequent are learned.
    """
    lang = F.col(lang_col).cast("string")
    usable = docs.where(lang.isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = usable.groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    langs = sorted(r.lang for r in counts)
    k, m = len(langs), code(len(langs))
    bits = m.shape[1]
    if k < 2:
        return LanguageModel(langs, m, np.zeros((size, bits)), np.zeros(bits), np.ones(bits), np.zeros((k, bits)))
    share = max(1, max_training // k)
    # a row is taken where its hash, from 0 to 1, is below its language's threshold: the texts of the corpus are only filtered
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, share / r["count"]))])
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = usable.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "doc_id").where(hashed < F.try_element_at(limits, F.col("lang")))
    sample = cut(sample.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("tries")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros((k, size), np.int64), [Counter() for _ in range(k)]

        def add(i: int) -> None:
            if words[i]:
                slot, word = grams(list(words[i]), size)
                total[i] += np.bincount(slot, np.array(list(words[i].values()))[word], size).astype(np.int64)
            words[i].clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = langs.index(lang)
                for part in terms(text, LETTERS):
                    words[i].update(part)
                    if len(words[i]) > 50_000:
                        add(i)
        for i in range(k):
            add(i)
        lang, slot = np.nonzero(total)
        for at in range(0, len(slot), 50_000):
            i, j = lang[at : at + 50_000], slot[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"lang": i, "slot": j, "n": total[i, j]})

    rows = sample.where("not tries").select("lang", "text").mapInArrow(count, "lang long, slot long, n long")
    found = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most size x languages numbers
    share_of = np.zeros((k, size))
    share_of[found["lang"].to_numpy(), found["slot"].to_numpy()] = found["n"].to_numpy()
    share_of = (share_of + 0.5) / (share_of.sum(axis=1, keepdims=True) + 0.5 * size)
    side = lambda s: (share_of.T @ (m == s)) / np.maximum((m == s).sum(axis=0), 1)
    model = LanguageModel(langs, m, np.log(side(1)) - np.log(side(-1)), np.zeros(bits), np.ones(bits), np.full((k, bits), 1 / bits))

    shared = docs.sparkSession.sparkContext.broadcast(model)  # size x bits numbers

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = shared.value.evidence(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e.tolist(), pa.list_(pa.float64()))], ["lang", "e"])

    trial = sample.where("tries").select("lang", "text").mapInArrow(tried, "lang string, e array<double>").collect()  # a few numbers each
    if trial:
        e, y = np.array([r.e for r in trial]), np.array([langs.index(r.lang) for r in trial])
        _calibrate(model, e, y)
    return model


def _calibrate(model: LanguageModel, e: np.ndarray, y: np.ndarray) -> None:
    """Curves by bit, weights by language and bit, and the sharpness, from evidence and true languages."""
    k, bits = model.code.shape
    mass = (1 / np.maximum(np.bincount(y, minlength=k), 1))[y] * len(y) / k  # languages count alike
    for b in range(bits):
        model.shift[b], model.slope[b] = _logistic(e[:, b], (model.code[y, b] > 0).astype(float), mass)
    right = (model.shift + model.slope * e) * model.code[y] > 0
    for lang in range(k):
        n = (y == lang).sum()
        rate = (right[y == lang].sum(axis=0) + 1) / (n + 2)
        gain = np.maximum(rate - 0.5, 1e-3)  # what a bit knows of this language beyond chance
        model.weight[lang] = gain / gain.sum()
    loss = {}
    for sharp in 2.0 ** np.arange(-2, 8):
        model.sharp = float(sharp)
        loss[float(sharp)] = -(mass * np.log(model.probabilities(e)[np.arange(len(y)), y] + 1e-12)).mean()
    model.sharp = min(loss, key=loss.get)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous, runner_up``: a row for each row of ``docs``.

    ``score`` is the probability of the prediction.  A null text, or one without any letter, is ``und`` with score 0
    and not ambiguous; so is every text where no language was learned.  With one language learned every other text is
    that one, with score 1.  Whole texts are read, by pieces where they are long.  Null ids and repeated rows are
    as others; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x bits numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("runner_up", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                known = [bool(m.langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
                lang, score, vague, second = ([UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts), [None] * len(texts))
                where = [i for i, ok in enumerate(known) if ok]
                if where and len(m.langs) == 1:
                    for i in where:
                        lang[i], score[i] = m.langs[0], 1.0
                elif where:
                    e = m.evidence([texts[i].encode() for i in where])
                    p = m.probabilities(e)
                    order = np.argsort(-p, axis=1, kind="stable")
                    top = p[np.arange(len(p)), order[:, 0]]
                    unsure = (m.distance(e, order[:, 0]) > m.correctable()) | (top < m.least)
                    for j, i in enumerate(where):
                        lang[i], score[i], vague[i], second[i] = m.langs[order[j, 0]], float(top[j]), bool(unsure[j]), m.langs[order[j, 1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(vague), pa.array(second, pa.string())], kind.names)

    return rows.mapInArrow(each, kind)
