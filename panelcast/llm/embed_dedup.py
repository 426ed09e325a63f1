"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= c lie within Euclidean distance r = sqrt(2 - 2c).  A few vectors of
each label serve as pivots; every vector belongs to the cell of its nearest pivot and is copied
into another cell only where the triangle inequality allows a partner there.  Cells are then
joined on their own, in blocks of bounded size, and every link is checked by cosine.

A block pair gives sums of links for each vector and a spanning forest of its links, never the
pairs themselves, so its output grows with its vectors.  Copies of one vector are joined once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, cut, join_sized

SLACK = 1e-6  # rounding in distances to pivots; cells are only made larger by it


def usable() -> Column:
    """Whether a row can link: label known, vector not null, not zero, with finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))


def _unit(rows: list) -> np.ndarray:
    v = np.asarray(rows, np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose_pivots(distinct: DataFrame, most_bytes: int = 64 << 20) -> dict:
    """Unit vectors by (label, dimension): half the cube root of a label's vectors, two at least.

    So every label has cells and, on vectors without any structure, where a vector is copied to about
    half the cells, copies grow with the cube root of a label only.  A hash picks about twice as many
    candidates and eight more; of these each pivot is the one farthest from the pivots before it.  All
    pivots together take ``most_bytes`` at most; beyond that every label gets its share of them.
    """
    sizes = distinct.groupBy("label", "dim").count().where("count > 1 and dim > 0")
    sizes = sizes.withColumn("wanted", F.greatest(F.lit(2), F.ceil(F.cbrt("count") / 2)))
    total = sizes.agg(F.sum(F.col("wanted") * F.col("dim") * 8)).first()[0] or 0
    sizes = sizes.withColumn("wanted", F.floor(F.col("wanted") * min(1.0, most_bytes / max(1, total)))).where("wanted > 1")
    u = F.pmod(F.xxhash64("first", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    many = 2 * F.col("wanted") + 8
    some = distinct.join(sizes, ["label", "dim"]).where(u < 2 * many / F.col("count"))
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy(u, "first"))
    found: dict = {}
    for r in some.select("label", "dim", "embedding", "wanted", many.alias("many"), place.alias("place")).where("place <= many").collect():  # a few times most_bytes
        found.setdefault((r.label, r.dim, r.wanted), []).append(r.embedding)
    return {(label, dim): _farthest(_unit(v), wanted) for (label, dim, wanted), v in found.items()}


def _farthest(units: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows: the first, then each time the one whose nearest chosen row is farthest."""
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(n, len(units)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (a[i], b[i])."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def deal(distinct: DataFrame, pivots: dict, cosine: float, most_numbers: int = 1 << 20) -> DataFrame:
    """``label, dim, cell, home, node, copies, embedding``: each vector in its own cell and wherever a partner may be at home.

    Matrices of vectors x pivots hold ``most_numbers`` numbers at most.
    """
    r = math.sqrt(2 - 2 * cosine) + SLACK
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)  # bounded in bytes by ``choose_pivots``

    def place(rows: list, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dots = _unit(rows) @ at.T
        d = np.sqrt(np.maximum(0, 2 - 2 * dots))
        home = d.argmin(axis=1)
        near = d[np.arange(len(d)), home][:, None]
        # a partner y in cell j has d(y, j) <= d(y, home of x), so d(x, j) <= d(x, home) + 2 r; the
        # halfspace between two pivots is at least (d(x, j)^2 - d(x, home)^2) / (2 d(home, j)) away
        between = np.sqrt(np.maximum(0, 2 - 2 * at @ at.T))[home]
        wall = np.divide(d * d - near * near, 2 * between, out=np.zeros_like(d), where=between > 1e-9)
        reach = (d <= near + 2 * r) & (wall <= r + SLACK)
        reach &= np.arange(at.shape[0])[None, :] <= home[:, None]  # the lower cell of two joins them
        reach[np.arange(len(d)), home] = True
        own, cell = np.nonzero(reach)
        return own, cell, home[own]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            for key in dict.fromkeys(keys):
                at, index = shared.value.get(key), np.array([i for i, k in enumerate(keys) if k == key])
                step = max(1, most_numbers // max(1, 0 if at is None else len(at)))
                for k in range(0, len(index), step):
                    part = batch.take(pa.array(index[k : k + step]))
                    if at is None:  # a label without pivots is one cell
                        own, cell, home = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                    else:
                        own, cell, home = place(part.column("embedding").to_pylist(), at)
                    out = part.take(pa.array(own))
                    cols = {c: out.column(c) for c in ("label", "dim")} | {"cell": pa.array(cell, pa.int32()), "home": pa.array(home, pa.int32())}
                    yield pa.RecordBatch.from_pydict(cols | {c: out.column(c) for c in ("node", "copies", "embedding")})

    kind = distinct.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, cell int, home int, node long, copies long, embedding array<double>"
    return distinct.select("label", "dim", "embedding", "node", "copies").mapInArrow(each, schema)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = 4000) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vec_id, embedding, label``.

    Vectors link when labels are equal and their cosine in double precision is at least ``cosine``;
    those of different length never link.  Vectors that are null, zero or hold null or non-finite
    components, or have no label, link with nothing.  Rows that repeat an id are vectors of their
    own with one id.  ``component_id`` is the smallest id reachable; rows with a null id take part
    in links and name no component.  An empty table gives an empty result; other columns aren't read.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    distinct = (
        base.where(usable())
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("label", F.size("embedding").alias("dim"), "embedding", "first", "copies", F.monotonically_increasing_id().alias("node"))
    )
    distinct = cut(distinct, "distinct-vectors")
    dealt = cut(deal(distinct, choose_pivots(distinct), cosine), "cells")
    # a cell is joined in pairs of blocks, each block of about ``block`` members
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = dealt.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "home", "node", "copies", "embedding"
    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, cell = pdf["p"].iat[0], pdf["q"].iat[0], pdf["cell"].iat[0]
        unit, node, home = _unit(pdf["embedding"].tolist()), pdf["node"].to_numpy(), pdf["home"].to_numpy()
        copies, part = pdf["copies"].to_numpy(), pdf["part"].to_numpy()
        links, edges = np.zeros(len(node), np.int64), []
        # one of the two is at home here; inside one block each pair is seen once
        inside = home == cell
        for left, right, once in ((inside & (part == p), part == q, p == q), (~inside & (part == p), inside & (part == q), False)):
            if p == q and not once:
                continue  # members from elsewhere met those at home in the first turn
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                close = unit[rows] @ unit[right].T >= cosine
                if once:
                    close &= (node[rows][:, None] < node[right][None, :]) | ~inside[right][None, :]
                i, j = np.nonzero(close)
                i, j = rows[i], right[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                edges += _forest(node[i], node[j])
        a = np.array([e[0] for e in edges], np.int64)
        forest = _forest(a, np.array([e[1] for e in edges], np.int64))
        some = np.flatnonzero(links)
        return pd.DataFrame({
            "node": np.concatenate([node[some], np.array([e[0] for e in forest], np.int64)]),
            "links": np.concatenate([links[some], np.zeros(len(forest), np.int64)]),
            "to": pd.array([None] * len(some) + [e[1] for e in forest], "Int64"),
        })

    found = cut(
        pairs.groupBy("label", "dim", "cell", "p", "q").applyInPandas(join, "node long, links long, to long"), "vector-links"
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    least = (
        classes.join(distinct.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    )
    per_vector = (
        distinct.join(counts, "node", "left")
        .join(classes.join(least, "component").select("node", "component_id"), "node", "left")
        .select(
            "label",
            "embedding",
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "first").alias("component_id"),
        )
    )
    per_vector = cut(per_vector, "linked-vectors")
    joined = join_sized(base.where(usable()), per_vector, ["label", "embedding"], "copies", F.monotonically_increasing_id()).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
