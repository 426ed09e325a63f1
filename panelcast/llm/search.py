"""Ranked lexical search of many items by dense blocked matrix products.

A document's impact for a term and an item's weight of it are integers, and a score is the sum of
their products.  Items are dealt into tiles with a compact vocabulary each, their weights are a
dense matrix, and so are the impacts of a tile of documents on the terms of that vocabulary which
these documents hold.  The product of the two in float64 is exact: a tile has so few terms that no
partial sum can reach 2^53.  Tiles of the vocabulary add up in 64-bit integers.  Each tile of
documents keeps an item's best, ties by id, so the best of all is among them.

The corpus is cut into terms once, keeping only occurrences of terms of items; document frequencies
come from these rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .terms import WORDS, term_counts

EXACT = 2**53  # integers up to it are exact in float64
MOST_IMPACT = 1_000_000  # fixed value: 1,000,000,000 tf / (1000 tf + 8 m) stays below it


@dataclass
class Block:
    """Items of bounded size: their terms as numbers of one vocabulary, each term once an item, and its weights."""

    words: dict[bytes, int]
    terms: list[np.ndarray]  # by item
    weight: np.ndarray | None = None
    docs: int = 0
    total: int = 0  # terms of all documents
    item_tile: int = 256
    width: int = 2048
    _tiles: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tiles": None}

    def tiles(self) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Tiles of items: first item, number, the tile's vocabulary, and its nonzero weights as (item, place in the vocabulary)."""
        if self._tiles is None:
            self._tiles = []
            for at in range(0, len(self.terms), self.item_tile):
                part = self.terms[at : at + self.item_tile]
                both = np.concatenate(part)
                own, place = np.unique(both, return_inverse=True)
                self._tiles.append((at, len(part), own, np.repeat(np.arange(len(part)), [len(p) for p in part]), place))
        return self._tiles

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each tile of items: its first item, and items x documents scores of ``n_docs`` documents with the given impacts."""
        width = max(1, min(self.width, (EXACT - 1) // (MOST_IMPACT * max(1, int(self.weight.max(initial=0))))))
        here = np.zeros(len(self.weight), bool)
        here[term] = True
        for at, n_items, own, item, place in self.tiles():
            used = np.flatnonzero(here[own])  # terms of the tile that some of these documents hold
            column = np.full(len(own), -1)
            column[used] = np.arange(len(used))
            slot = np.searchsorted(own, term).clip(max=max(len(own) - 1, 0))
            of = np.where(own[slot] == term, column[slot], -1) if len(own) else np.full(len(term), -1)
            total = np.zeros((n_items, n_docs), np.int64)
            for low in range(0, len(used), width):
                n = min(width, len(used) - low)
                mine = (of >= low) & (of < low + n)
                impacts = np.zeros((n, n_docs))
                impacts[of[mine] - low, doc[mine]] = impact[mine]
                given = (column[place] >= low) & (column[place] < low + n)
                weights = np.zeros((n_items, n))
                weights[item[given], column[place[given]] - low] = self.weight[own[place[given]]]
                total += (weights @ impacts).astype(np.int64)
            yield at, total


class Best:
    """The ``k`` best documents of each item so far, by score, then id (nulls first)."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, score, ids, null = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, ~null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(item)])
        rank = np.arange(len(item)) - np.repeat(first, size)
        keep = rank < self.k
        self.item, self.score, self.id, self.null = item[keep], score[keep], ids[keep], null[keep]
        full = first[size >= self.k]  # others may still take any document with a score
        self.least[item[full]] = score[full + self.k - 1]


def _blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[tuple[list[Row], Block]]:
    """The items in blocks of some ``most_bytes`` bytes of text; one in all unless there are more."""
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = math.ceil(size / most_bytes)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows
        got = part.collect()  # of bounded size
        words: dict[bytes, int] = {}
        terms = [np.array(sorted(words.setdefault(w, len(words)) for w in term_counts(r.text.encode(), WORDS)), np.int64) for r in got]
        if words:
            yield got, Block(words, terms)


def postings(docs: DataFrame, words: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tf``: for each document with terms, how many it has and the occurrences of those in ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # of one block of items
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, terms, tf = [], [], []
                for text in part.column(1).to_pylist():
                    found = term_counts(text, WORDS)
                    hits = [(known[w], c) for w, c in found.items() if w in known]
                    n.append(found.total())
                    terms.append([h[0] for h in hits])
                    tf.append([h[1] for h in hits])
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "tf"]).filter(pa.array([x > 0 for x in n], pa.bool_()))

    return rows.mapInArrow(each, "doc_id long, n long, terms array<int>, tf array<long>")


def _best(rows: DataFrame, block: Block, k: int, doc_tile: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task; ``item`` is the number in the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = Best(len(b.terms), k)
        for batch in batches:
            for at in range(0, batch.num_rows, doc_tile):
                tile = batch.slice(at, doc_tile)
                ids, lists = tile.column(0), tile.column(2)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy()
                m = np.array([100 - 90 + 90 * n * b.docs // b.total for n in tile.column(1).to_pylist()], np.int64)
                doc = np.repeat(np.arange(tile.num_rows), np.diff(lists.offsets.to_numpy()))
                term, tf = lists.flatten().to_numpy(), tile.column(3).flatten().to_numpy()
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                for first, scores in b.scores(doc, term, impact, tile.num_rows):
                    i, d = np.nonzero(scores >= best.least[first : first + len(scores), None])
                    best.add(first + i, scores[i, d], number[d], null[d])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id, mask=best.null), pa.array(best.score)], ["item", "doc_id", "score"])

    return rows.mapInArrow(each, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", most_bytes: int = 32 << 20, doc_tile: int = 512) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each row of ``items``.

    Equal scores go by ascending id, nulls first; repeated rows of ``docs`` are documents of their own, and
    repeated rows of ``items`` are ranked each.  Null texts have no terms; an item without terms, or whose
    terms no document has, has no rows, and neither has an empty table.  Very long texts are cut into terms
    by pieces.  Other columns are not read.

    Items beyond ``most_bytes`` are dealt into blocks by hash, and each block takes its own pass over ``docs``,
    so what is sent to the tasks has a bound.
    """
    spark, out = docs.sparkSession, None
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType)])
    for rows, block in _blocks(items, item_id, text, most_bytes):
        found = cut(postings(docs, block.words), "postings")
        sums = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
        block.docs, block.total = sums.docs, sums.total or 1
        df = np.zeros(len(block.words), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a number a term of the block
            df[r.term] = r["count"]
        block.weight = np.array([math.floor(1000 * math.log((2 * block.docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        own = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        part = Window.partitionBy("item", "part").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        one = _best(found, block, k, doc_tile).withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
        one = one.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)  # many tasks' best in two steps
        one = one.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], kind)
        one = one.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row an item of the block
        out = one if out is None else out.unionByName(one)
    empty = T.StructType([kind["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return spark.createDataFrame([], empty) if out is None else out
