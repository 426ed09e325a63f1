import os
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from panelcast.llm import mixing as m
from panelcast.llm import queries as q
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def plain(n, p, share, floor, most=np.inf, steps=30000):
    """Plain projected gradient steps, of length 1 for misses over their domain's tokens."""
    r, have, of = np.ones(len(n)), n @ p, np.eye(p.shape[1]) - np.outer(share, np.ones(p.shape[1])) * (floor > 0)
    for _ in range(steps):
        miss = of @ ((r * n) @ p) - (0 if floor else np.array(share) * n.sum())
        r = np.clip(r - p @ (of.T @ (miss / have)) / 2, floor, most)
    return (r * n) @ p


def exact(n, p, want):
    """Newton's method on one multiplier a domain: the rates nearest to 1 that meet the targets, where these can be met."""
    x = np.zeros(p.shape[1])
    for _ in range(200):
        r = np.maximum(0.0, 1 + p @ x)
        miss = (r * n) @ p - want
        way = np.linalg.solve((p * (n * (r > 0))[:, None]).T @ p + 1e-12 * n.sum() * np.eye(len(x)), miss)
        size = 1.0
        while size > 1e-6 and np.abs((np.maximum(0.0, 1 + p @ (x - size * way)) * n) @ p - want).max() > np.abs(miss).max():
            size /= 2
        x = x - size * way
    return (np.maximum(0.0, 1 + p @ x) * n) @ p


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_match_brute_force(spark, floor):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 500, 300)
    p = rng.dirichlet([4.0, 1.0, 0.5], 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    share = np.array([0.6, 0.3, 0.1])
    mix = m.fit_rates(members, share.tolist(), floor)
    got = np.array([r.r for r in members.select(m.rate(F.col("p"), mix.steps, floor).alias("r")).collect()])
    assert got.min() >= floor and np.allclose((got * n) @ p, mix.reached)
    if floor:
        assert np.allclose(mix.targets, share * sum(mix.reached))
    else:
        assert np.allclose(mix.targets, share * n.sum()) and np.allclose(mix.reached, exact(n, p, share * n.sum()), rtol=1e-3)
    assert np.abs(np.array(mix.reached) - mix.targets).max() < 2e-5 * sum(mix.reached)
    assert np.abs(plain(n, p, share, floor) / plain(n, p, share, floor).sum() - share).max() < 1e-2  # plain steps are on the way there


def test_rates_are_written_every_ten_steps(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 500, 400), rng.dirichlet([0.2, 0.2, 0.2, 0.05], 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    cuts, cut = [], m.cut
    monkeypatch.setattr(m, "cut", lambda df, name: cuts.append(name) or cut(df, name))
    mix = m.fit_rates(members, [0.05, 0.05, 0.05, 0.85], 0.0)
    got = np.array([r.r for r in members.select(m.rate(F.col("p"), mix.steps, 0.0).alias("r")).collect()])
    assert len(cuts) == len(mix.steps) // 10
    assert np.allclose((got * n) @ p, mix.reached) and np.abs(np.array(mix.reached) - mix.targets).max() < 2e-5 * n.sum()


def corpus(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        kind = rnd.choice(["high"] * 6 + ["low"] * 3 + ["toxic"])
        own = {"high": ["fine", "good", "clear"], "low": ["junk", "spam%%%", "|"], "toxic": ["vile", "nasty", "mean"]}[kind]
        rows.append((i, " ".join(rnd.choice(own + ["the", "of", "and"]) for _ in range(rnd.randint(5, 80))), i))
        labels.append((i, 0 if kind == "low" else 1, 1 if kind == "toxic" else 0))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, rate long"), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"), labels


def test_mix_meets_targets_and_learns_domains(spark):
    rows, docs, labels, all_labels = corpus(spark)
    got = {r.doc_id: r for r in m.mix(docs, labels).collect()}
    assert len(got) == 600
    name = lambda q, t: "toxic" if t else "low" if not q else "high"
    right = sum(max(m.DOMAINS, key=lambda d: got[i][f"p_{d}"]) == name(q, t) for i, q, t in all_labels[400:])
    assert right / 200 > 0.95
    tokens = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) for d in m.DOMAINS}
    total = sum(r.n_tokens for r in got.values())
    for d, w in m.TARGETS.items():
        assert abs(tokens[d] / total - w) < 1e-3
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got.values())


def test_mixed_documents_keep_every_row(spark):
    rows, docs, labels, _ = corpus(spark)
    out = m.mixed_documents(docs, labels)
    assert out.columns == docs.columns
    odd = docs.withColumnsRenamed({"rate": "p"}).withColumns({"n_tokens": F.lit(1), "nth": F.lit(2), "_p": F.lit(3), "__rate": F.lit(4)})
    again = m.mixed_documents(odd, labels)
    assert again.columns == odd.columns and again.count() == out.count()
    assert {tuple(r) for r in out.collect()} == set(rows) and out.count() > 600


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_meets_its_targets_on_the_tables(spark):
    got = q.op5_mixing(spark, DATA).select("doc_id", "n_tokens", "rate", *[f"p_{d}" for d in m.DOMAINS]).toPandas()
    docs = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert dict(zip(got.doc_id, got.n_tokens)) == docs
    assert got.rate.min() >= 0
    for d, w in m.TARGETS.items():
        assert abs((got.rate * got.n_tokens * got[f"p_{d}"]).sum() / got.n_tokens.sum() / w - 1) < 1e-3, d


def test_posteriors_and_copies_by_definition(spark):
    rows, docs, labels, _ = corpus(spark)
    model = m.fit_domains(docs, labels)
    texts = {i: t for i, t, _ in rows}
    for r in m.mix(docs, labels).collect():
        words = texts[r.doc_id].split()
        mean = sum((model.table[zlib.crc32(w.encode()) % len(model.table)] for w in words), np.zeros(3)) / max(len(words), 1)
        odds = np.exp(model.prior + model.sharp * mean - (model.prior + model.sharp * mean).max())
        assert np.allclose([r[f"p_{d}"] for d in m.DOMAINS], odds / odds.sum(), atol=1e-9) and r.n_tokens == len(words)
        hashed = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42))
        assert r.copies == int(np.floor(r.rate + ((hashed + 2**63) % 2**64 - 2**63) % (1 << 30) / (1 << 30)))


def test_domains_left_out_are_not_learned(spark):
    _, docs, labels, _ = corpus(spark)
    model = m.fit_domains(docs, labels, domains=("high", "low"))
    assert model.table.shape[1] == 2
    out = m.mixed_documents(docs, labels, {"high": 0.9, "low": 0.08})
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(600))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "w " * 50000), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = m.mix(docs, none).collect()
    assert len(got) == 5 and all(r.rate >= 0 for r in got)
    assert m.mixed_documents(docs, none).count() >= 5
    assert m.mix(docs.limit(0), none).count() == 0
    assert m.mixed_documents(docs.limit(0), none).count() == 0


def test_rare_domains_reach_their_targets(spark, caplog):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 500, 2000)
    p = np.where(rng.random((2000, 1)) < 0.005, [[0.05, 0.05, 0.9]], rng.dirichlet([2.0, 6.0, 0.001], 2000) * 0.999 + 0.001 / 3)
    want = np.array([0.3, 0.4, 0.3]) * n.sum()
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    mix = m.fit_rates(members, [0.3, 0.4, 0.3], most=None)
    r = np.array([x.r for x in members.select(m.rate(F.col("p"), mix.steps, 0.0, None).alias("r")).collect()])
    assert r.min() >= 0 and r.max() > 8
    assert np.allclose((r * n) @ p, want, rtol=1e-4) and np.allclose(mix.reached, want, rtol=1e-4)
    assert not caplog.records


def test_targets_out_of_reach_are_logged_and_missed_least(spark, caplog):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 500, 200)
    p = np.array([0.3, 0.2, 0.1]) + rng.random((200, 3)) * 0.1
    p /= p.sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    have, want = n @ p, np.array([0.1, 0.1, 0.8]) * n.sum()
    share = np.array([0.1, 0.1, 0.8])
    for floor, most in ((0.0, None), (0.0, 8.0), (1.0, 8.0)):
        caplog.clear()
        mix = m.fit_rates(members, share.tolist(), floor, most=most)
        miss = (np.array(mix.reached) - mix.targets) / have
        slope = p @ (miss - (share @ miss) * (floor > 0))  # of the squared misses, by rate
        r = np.array([x.r for x in members.select(m.rate(F.col("p"), mix.steps, floor, most).alias("r")).collect()])
        assert r.min() >= floor and r.max() <= (most or np.inf)
        assert slope[r > floor + 1e-9].max(initial=-1) < 1e-2
        assert slope[r < (most or np.inf) - 1e-9].min(initial=1) > -1e-2
        assert sum("target missed" in x.getMessage() for x in caplog.records) >= 1
