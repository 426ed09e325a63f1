import random
import zlib

import numpy as np
from panelcast.llm import queries as q
from panelcast.llm import toxicity as m
from pyspark.sql import functions as F


def brute_segments(s):
    """Maximal segments by definition: take the best segment, then go on left and right of it."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += s[j]
                if t > 0 and (top is None or t > top[2] + 1e-12):
                    top = (i, j + 1, t)
        return top
    out, todo = [], [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if b := best(lo, hi):
            out.append(b)
            todo += [(lo, b[0]), (b[1], hi)]
    return sorted(out)


def test_segments_match_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        s = np.array([rnd.choice([-3.1, -1.7, -0.5, -0.5, 0.9, 2.3, 4.45]) + rnd.random() / 1e3 for _ in range(rnd.randint(0, 25))])
        got, want = m.segments(s), brute_segments(s.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def corpus(spark, n=1500):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 400))]
        bad = i % 8 == 0
        if bad:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(["zzkot", "vvqua" + rnd.choice(plain)]) for _ in range(4)]
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_accuracy_and_passages(spark):
    rows, docs, labels = corpus(spark)
    model = m.fit(docs, labels)
    got = {r.doc_id: r for r in m.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(m.fold(F.col("doc_id")) == 0).collect()}
    assert len(held) > 200
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in rows if i in held)
    text = rows[0][1].split()
    found, n = model.passages(rows[0][1])
    s, e, _ = max(found, key=lambda x: x[2])
    assert n == len(text) and all(w.startswith(("zzkot", "vvqua")) for w in text[s:e])
    kept = m.reject_toxic(docs.withColumn("score", F.lit(9)), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_passages_are_returned_in_code_points(spark):
    rows, docs, labels = corpus(spark)
    model = m.fit(docs, labels)
    toxic = {i for i, _, y in rows if y}
    text = {i: t for i, t, _ in rows}
    hits = 0
    for r in m.score(docs, model).collect():
        assert r.n_passages == len(r.passages)
        for p in r.passages:
            part = text[r.doc_id][p.start : p.end]
            assert part == part.strip() and p.value > m.SIGNIFICANT
            hits += r.doc_id in toxic and any(w.startswith(("zzkot", "vvqua")) for w in part.split())
    assert hits > 0.9 * len(toxic)


def test_joint_statistic_rises_with_further_segments():
    assert m.joint([]) == -np.inf and m.joint([-3.0, -5.0]) == -3.0 and m.joint([2.0]) == 2.0
    assert m.joint([4.0, 3.5, 3.5]) > m.joint([4.0, 3.5]) > m.joint([4.0]) == m.joint([4.0, -1.0])
    # r values drawn from the law of chance segments: the joint p value is rarely small
    rng = np.random.default_rng(0)
    draws = [m.joint(np.log(1 / np.cumsum(rng.exponential(size=20))).tolist()) for _ in range(4000)]
    assert np.mean(np.array(draws) > 3) < 2.5 * np.exp(-3)


def test_query_columns_match_brute_force(spark, tmp_path):
    """``held_out``, ``score`` and ``predicted`` of the registered query, from the model alone."""
    rows, docs, labels = corpus(spark, 400)
    docs = docs.union(spark.createDataFrame([(5000, None), (5001, ""), (5002, "é " * 30000)], docs.schema))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = m.fit(docs, labels)
    got = {r.doc_id: r for r in q.op3_toxicity(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = m.WORD.findall(t or "")
        s = np.array([model.odds(w)[0] for w in words]) - model.cost
        best = [x for _, _, x in brute_segments(s.tolist())] if len(words) < 60 else []
        stat = m.joint([model.lam * x - np.log(model.k * len(words)) for x in best]) if best else m.NEVER
        want = 1 / (1 + np.exp(-(model.a + model.b * min(m.MOST, max(m.NEVER, stat)))))
        if len(words) < 60 or len(words) > 500:
            assert abs(got[i].score - want) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "w " * 60000), (3, "x")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = m.fit(docs, labels)
    assert len([r for r in m.score(docs, model).collect() if 0 <= r.score <= 1]) == 5
    assert m.score(docs.limit(0), model).count() == 0
