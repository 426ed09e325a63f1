"""Divergence of sources by the terms they use.

Each language keeps the terms that enough of its documents hold.  A (language, source) group gives
each of them a smoothed integer probability p, and so does the language (q).  Two distributions
differ by the sum of ``floor((p - q)^2 / (p + q))`` over all kept terms.

Most groups lack most terms, and a term they both lack adds the same to a pair each time.  So a pair's
sum is taken as if no group held any term, plus a correction for each term one of them holds (from
counts of equal counts), plus a correction for each term both hold.  The last part would visit every
pair of sources of every term.  Instead the term's nonzero counts, ordered by source, are a row that is
inserted into a frequent-pattern tree with the number of terms that have the same row.  Terms that
begin alike share a path, and every node meets each of its ancestors once, whatever the number of
terms below it.  Rows are dealt by range and sorted, so those that share a path are neighbours; a path
that two batches share is two paths with fewer terms each, and the sums are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_sized
from .terms import LETTERS, term_counts

SCALE = 1_000_000_000  # fixed value: the unit of probabilities
GROUP = ["lang", "source"]


def probability(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE (n + 2) / (total + 2 kept))`` in exact arithmetic; 1 where no term is kept."""
    part = F.call_function("div", (n + F.lit(2)).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.greatest(total + F.lit(2) * kept, F.lit(1)).cast("decimal(38,0)"))
    return F.when(kept > 0, part + 1).otherwise(F.lit(1)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


ONE_DOC = 1 << 40  # a task's entry is occurrences + documents * ONE_DOC


def _listed(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    """Runs of ``values`` that end at ``ends`` as lists."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def count_terms(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """``lang, term, docs, sources, n``: partial counts of a term, with its sources in lists.

    A task hands its counts on before they exceed ``most`` pairs of a term and a source by more than a document's.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, dict[bytes, int]]] = {}  # lang -> source -> term
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(lang, {}).setdefault(source, {})
                before, get = len(own), own.get
                for term, n in term_counts(text, LETTERS).items():
                    own[term] = get(term, 0) + n + ONE_DOC
                size += len(own) - before
                if size > most:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, sources in held.items():
            both = np.concatenate([np.fromiter(own.values(), np.int64, len(own)) for own in sources.values()])
            if not len(both):
                continue
            coded = pa.array([t for own in sources.values() for t in own], pa.binary()).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.bincount(code).cumsum()
            both, terms = both[order], coded.dictionary
            found = np.add.reduceat(both // ONE_DOC, np.r_[0, ends[:-1]])
            of = pa.array(np.repeat(np.arange(len(sources)), [len(own) for own in sources.values()])[order])
            names, n = _listed(pa.array(list(sources), pa.string()).take(of), ends), _listed(pa.array(both % ONE_DOC), ends)
            for at in range(0, len(terms), 10_000):
                part = terms.slice(at, 10_000)
                cols = [pa.array([lang] * len(part), pa.string()), part, pa.array(found[at : at + 10_000]), names.slice(at, 10_000), n.slice(at, 10_000)]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "term", "docs", "sources", "n"])

    return rows.mapInArrow(each, "lang string, term binary, docs long, sources array<string>, n array<long>")


_ROW = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring rows of a term as one, its sources in order of their bytes and their counts summed."""
    lang, term, docs, sources, n = batch.columns
    new = np.r_[True, pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)]
    start, group = np.flatnonzero(new), new.cumsum() - 1
    coded = sources.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    key = np.repeat(group, np.diff(sources.offsets.to_numpy())) * max(len(names), 1) + rank[coded.indices.to_numpy()]
    key, of = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, of, n.flatten().to_numpy())
    owner, place = np.divmod(key, max(len(names), 1))
    ends = np.bincount(owner, minlength=len(start)).cumsum()
    named = pa.array([names[i] for i in order], pa.string()).take(pa.array(place))
    at = pa.array(start)
    return pa.RecordBatch.from_arrays([lang.take(at), term.take(at), pa.array(np.add.reduceat(docs.to_numpy(), start)), _listed(named, ends), _listed(pa.array(total), ends)], batch.schema.names)


def term_rows(docs: DataFrame, least: int) -> DataFrame:
    """``lang, term, n, row``: the kept terms with their occurrences, in all and by source (``source, n``, in order of the source).

    Partial counts are dealt and sorted by term, and neighbours are merged as they come, so a task holds a batch and one
    term's sources, however many tasks counted the term.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            merged = _merged(batch if rest is None else pa.Table.from_batches([rest, batch.cast(rest.schema)]).combine_chunks().to_batches()[0])
            rest = merged.slice(merged.num_rows - 1)  # its term may go on in the next batch
            yield kept(merged.slice(0, merged.num_rows - 1))
        if rest is not None:
            yield kept(rest)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(batch.column(2).to_numpy() >= least))
        lang, term, _, sources, n = batch.columns
        ends = np.diff(sources.offsets.to_numpy()).cumsum()
        counts = n.flatten().to_numpy()
        sums = np.add.reduceat(counts, np.r_[0, ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        row = _listed(pa.StructArray.from_arrays([sources.flatten(), pa.array(counts)], ["source", "n"]), ends)
        return pa.RecordBatch.from_arrays([lang, term, pa.array(sums), row], ["lang", "term", "n", "row"])

    hashed = F.xxhash64("lang", "term")
    dealt = count_terms(docs).withColumn("h", hashed).repartition("h").sortWithinPartitions("h", "lang", "term").drop("h")
    return dealt.mapInArrow(each, "lang string, term binary, n long, row array<struct<source:string,n:long>>").withColumn("term", F.col("term").cast("string"))


class PatternTree:
    """Rows of sources with their p and zero as paths from a root; a node has the number of terms whose row begins with its path.

    Rows come sorted, so a row shares with those before it just what it shares with the last one: the nodes of a level
    are the rows whose path differs from the last row's there or above, and every node is known by its first row.
    """

    def __init__(self, source: np.ndarray, p: np.ndarray, zero: np.ndarray, ends: np.ndarray, terms: np.ndarray):
        """Flat values of all rows; row i ends before ``ends[i]``; ``source`` has numbers."""
        self.source, self.p, self.zero = source, p, zero
        self.start = np.r_[0, ends[:-1]].astype(np.int64)
        self.depth, self.terms = np.diff(np.r_[0, ends]), terms
        rows = np.arange(len(ends))
        shared = np.zeros(len(ends), np.int64)  # how far a row goes along with the one before
        on = rows[1:]
        for level in range(int(self.depth.max(initial=0))):
            on = on[(self.depth[on] > level) & (self.depth[on - 1] > level)]
            here, last = self.start[on] + level, self.start[on - 1] + level
            on = on[(source[here] == source[last]) & (p[here] == p[last])]
            shared[on] = level + 1
        self.shared = shared

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of level ``k``: the first row of each, and the number of terms below it."""
        rows = np.flatnonzero(self.depth > k)
        new = self.shared[rows] <= k
        return rows[new], np.add.reduceat(self.terms[rows], np.flatnonzero(new)) if len(rows) else np.zeros(0, np.int64)

    def corrections(self, sources: int) -> np.ndarray:
        """By pair of sources: what terms that both hold add beyond what each of them adds alone; each node meets each ancestor once."""
        out = np.zeros(sources * sources, np.int64)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for k in range(1, int(self.depth.max(initial=0))):
            rows, terms = self.level(k)
            node = self.start[rows] + k
            p, zero = self.p[node], self.zero[node]
            for above in range(k):
                at = self.start[rows] + above
                q, none = self.p[at], self.zero[at]
                np.add.at(out, self.source[at] * sources + self.source[node], terms * (f(q, p) - f(q, zero) - f(none, p) + f(none, zero)))
        return out.reshape(sources, sources)


def _shared_terms(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the trees' corrections for pairs of sources; a tree has the rows of a batch and a language."""
    kind = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                coded = own.column(1).flatten().dictionary_encode()
                names, flat = coded.dictionary.to_pylist(), lambda i: own.column(i).flatten().to_numpy()  # noqa: B023
                ends = np.diff(own.column(1).offsets.to_numpy()).cumsum()
                found = PatternTree(coded.indices.to_numpy().astype(np.int64), flat(2), flat(3), ends, own.column(4).to_numpy()).corrections(len(names))
                a, b = np.nonzero(found)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(a), "a": [names[i] for i in a], "b": [names[i] for i in b], "value": found[a, b]}, schema=kind)

    dealt = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    flat = dealt.select("lang", "row.source", "row.p", "row.zero", "terms")
    return flat.mapInArrow(each, "lang string, a string, b string, value long")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far every group is from each other source of its language and which terms it has too much of.

    Part ``pair`` has every other source of the language; part ``term`` the ``top`` terms that the group has
    and gives more than the language does.  Ranks go by value, falling, then item.  Null language, source
    or text is ''.  A row is a document, so repeated rows count each; null ids, empty and very long texts
    are as others, a group without terms has pairs and no terms, a language with one source no pairs, an
    empty table no rows; other columns are not read.
    """
    terms = cut(term_rows(docs, least), "term-rows")
    entries = terms.select("lang", "term", F.col("n").alias("n_lang"), F.explode("row").alias("e")).select("lang", "term", "n_lang", "e.source", "e.n")
    totals = entries.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct().join(totals, GROUP, "left").join(langs, "lang", "left").fillna(0)
    groups = cut(groups.withColumn("zero", probability(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "source-groups")

    spread = F.xxhash64("term")
    placed = join_sized(entries, groups, GROUP, "held", spread)
    placed = cut(placed.select(*GROUP, "term", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "zero", probability(F.col("n_lang"), F.col("lang_total"), F.col("kept")).alias("q")), "term-entries")

    above = placed.where("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # what a pair has if no group held a term, and what each term adds that one of them holds
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("peers"))  # one entry a source
    alone = placed.groupBy(*GROUP, "p", "zero").agg(F.count(F.lit(1)).alias("terms")).unionByName(groups.select(*GROUP, F.lit(None).cast("long").alias("p"), "zero", F.col("kept").alias("terms")))
    sizes = alone.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    met = join_sized(alone, peers.join(sizes, "lang"), ["lang"], "rows", F.xxhash64("source", "p")).select(*GROUP, "p", "zero", "terms", F.explode("peers").alias("o"))
    base = divergence(F.col("zero"), F.col("o.zero"))
    added = F.when(F.col("p").isNotNull(), divergence(F.col("p"), F.col("o.zero")) - base).when(F.col("source") < F.col("o.source"), base).otherwise(0)
    lone = met.where(F.col("source") != F.col("o.source")).select("lang", F.least("source", "o.source").alias("a"), F.greatest("source", "o.source").alias("b"), (F.col("terms") * added).alias("value"))

    rows = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("row"))
    rows = cut(rows.groupBy("lang", "row").agg(F.count(F.lit(1)).alias("terms")), "pattern-rows")
    pairs = lone.unionByName(_shared_terms(rows)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    both = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(best))
    return both.unionByName(ranked)
