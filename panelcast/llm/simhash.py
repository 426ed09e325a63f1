"""SimHash near-duplicates through a bit-count grid.

Fingerprints (64 bits from word shingles) are mapped to 32 segments of two bits each;
a segment's bit count (0, 1 or 2) written in unary (00, 01, 11) makes the whole
embedding one long, and the Manhattan distance of two embeddings is the bit count of
their exclusive or.  That distance never exceeds the Hamming distance.

Range join: the segments are dealt into ``groups`` groups.  If the Manhattan distance is
at most r, all but r groups agree in every count, so two fingerprints meet in a grid cell
of at least one choice of ``groups - r`` groups.  Pairs from a cell are checked by
Manhattan distance, then by exact Hamming distance.

A cell with more than ``cell_limit`` fingerprints is not paired: its members are dealt anew
into a finer grid, where more segments must agree.  Those crowded even there (many fingerprints
whose counts agree) go to an exact way that costs 65 rows each.  Fingerprints are within
distance 2 exactly when they have a common point within distance 1, so each is tied to itself
and its 64 one-bit neighbours, and each such point links everything tied to it (65 at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, join_sized

LOW = 0x5555555555555555
SEGMENTS = 32
RADIUS = 2


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, step: int = 65536) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[len(words) - n :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())]
        octets = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per document, ``fp`` the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary, as one long."""
    low = F.lit(LOW)
    high = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(groups: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the segments in each choice of ``groups - radius`` groups, as signed longs."""
    of = [sum(3 << (2 * s) for s in range(SEGMENTS) if s % groups == g) for g in range(groups)]
    masks = [sum(of[g] for g in chosen) for chosen in combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, levels: tuple[int, ...] = (6, 12), cell_limit: int = 128) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints ``fp`` reachable in steps of Hamming distance <= 2.

    Within cells of up to ``cell_limit`` members every pair at distance <= 2 is an edge; members of
    larger cells go to the next of ``levels`` (numbers of segment groups), and after the last are tied
    through common one-bit neighbours instead.
    """
    groups = levels[0]
    cells = distinct.select("fp", embedding(F.col("fp")).alias("counts")).select(
        "fp",
        "counts",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("k"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell"))
                    for k, m in enumerate(cell_masks(groups))
                ]
            )
        ).alias("g"),
    ).select("fp", "counts", "g.k", "g.cell")
    sizes = cut(cells.groupBy("k", "cell").count().where("count > 1"), "cells")
    small, large = sizes.where(F.col("count") <= cell_limit), sizes.where(F.col("count") > cell_limit)

    members = cut(cells.join(small.select("k", "cell"), ["k", "cell"]), "cell-members")
    other = members.select("k", "cell", F.col("fp").alias("b"), F.col("counts").alias("b_counts"))
    near = (
        members.join(other, ["k", "cell"])
        .where("fp < b")
        .where(F.bit_count(F.col("counts").bitwiseXOR(F.col("b_counts"))) <= RADIUS)
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= RADIUS)
        .select(F.col("fp").alias("a"), "b")
    )
    if large.isEmpty():
        return near
    crowded = cut(cells.join(large.select("k", "cell"), ["k", "cell"]).select("fp").distinct(), "crowded")
    if levels[1:]:
        return near.union(links(crowded, levels[1:], cell_limit))
    points = crowded.select(
        "fp",
        F.explode(
            F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)])
        ).alias("point"),
    )
    ties = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    tied = ties.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.union(tied)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document.

    Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest id reachable
    by links.  Null, empty and blank texts have fingerprint zero and are linked like any other.
    Copies share a fingerprint and are handled once.  Rows with a null id get a row and take
    part in links, but never name a component unless no other member has an id.  Repeated rows
    give a row each.  Empty tables give empty results; other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    part = components(links(distinct))
    least = (
        part.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
        .groupBy("component")
        .agg(F.min("first").alias("component_id"))
    )
    named = part.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    both = cut(distinct.join(named, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first").alias("component_id")), "named-fingerprints")
    return join_sized(marked, both, ["fp"], "copies", F.monotonically_increasing_id()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
