import os

import numpy as np
import pytest
from panelcast.llm import embed_dedup as m
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def brute(rows, c):
    def good(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n, out = len(rows), [0] * len(rows)
    comp = list(range(n))
    link = [[False] * n for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and good(v, a) and good(w, b) and a == b and len(v) == len(w):
                link[i][j] = float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))) >= c
    for _ in range(n):
        comp = [min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)]
    best = {}
    for (vid, _, _), k in zip(rows, comp):
        best[k] = min([x for x in (best.get(k), vid) if x is not None], default=None)
    return sorted((str(r[0]), sum(link[i]), best[comp[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [4000, 7])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((at, (base + rng.normal(size=16) * rng.choice([0, 0.15, 0.3, 0.5])).tolist(), label))
                at += 1
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(6)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, rows[5][1], None)]
    rows += [(2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [1e-200] * 16, 1), (2007, [1e-200] * 16, 1), (None, [3e-200] * 16, 1), (2008, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("first", F.lit(1))
    got = m.near_duplicates(df, block=block).collect()
    for r in rows:  # the brute force squares these
        if r[1] and r[1][0] and abs(r[1][0] or 0) < 1e-100:
            r[1][:] = [x * 1e200 for x in r[1]]
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows, 0.93)


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def compared(cells):
    """Pairs that cells compare: one of the two at home there."""
    per = cells.groupBy("label", "dim", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("n"), F.count_if(F.col("home") != F.col("cell")).alias("o"))
    return per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("o"))).first()[0]


@pytest.mark.parametrize("noise,share", [(0.02, 0.35), (1.0, 1.0)])
def test_pivots_part_labels_and_no_pair_is_compared_twice(spark, noise, share):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 64))
    rows = [(i, (centres[rng.integers(4)] + noise * rng.normal(size=64)).tolist(), i % 3, 64, 1, i) for i in range(1500)]
    distinct = spark.createDataFrame(rows, "node long, embedding array<double>, label int, dim int, copies long, first long")
    pivots = m.choose_pivots(distinct)
    assert sorted(map(len, pivots.values())) == [4, 4, 4]
    pairs = compared(m.deal(distinct, pivots, 0.93))
    assert pairs <= share * 3 * 500 * 499 / 2
    assert sum(map(len, m.choose_pivots(distinct, 64 * 8 * 6).values())) <= 6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pairs_compared_on_the_tables(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where(m.usable())
    distinct = rows.groupBy("label", F.col("embedding").cast("array<double>").alias("embedding")).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("dim", F.size("embedding")).withColumn("node", F.col("first"))
    pivots = m.choose_pivots(distinct)
    sizes = [r["count"] for r in distinct.groupBy("label").count().collect()]
    assert len(pivots) == len(sizes) and min(map(len, pivots.values())) >= 2
    assert compared(m.deal(distinct, pivots, 0.93)) <= sum(n * (n - 1) / 2 for n in sizes)
