import random
import re
from collections import Counter

import numpy as np
from panelcast.llm import divergence as m

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    """The result by its definition, in Python integers."""
    docs = [(r.get("lang") or "", r.get("source") or "", TERM.findall((r.get("text") or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, words in own for t in set(words))
        kept = {t for t, n in df.items() if n >= least}
        count = {None: Counter()}
        for _, source, words in own:
            words = [w for w in words if w in kept]
            count.setdefault(source, Counter()).update(words)
            count[None].update(words)
        p = lambda s, t: 1 + 10**9 * (count[s][t] + 2) // (sum(count[s].values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count.keys() - {None}:
            pairs = [(o, sum(f(p(s, t), p(o, t)) for t in kept)) for o in count.keys() - {None, s}]
            over = [(t, f(p(s, t), p(None, t))) for t in kept if count[s][t] and p(s, t) > p(None, t)]
            for part, items, top in (("pair", pairs, None), ("term", over, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus(n=400, sources=7):
    rnd = random.Random(4)
    words = ["Über", "naïve", "tea", "TEA", "x1y", "日本", "a_b", "it's", *("".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 4))) for _ in range(60))]
    rows = []
    for i in range(n):
        source = f"s{rnd.randrange(sources)}" if i % 3 else "hot"
        own = words[hash(source) % 20 :] if i % 2 else words
        rows.append({"doc_id": i, "lang": rnd.choice(["aa", "aa", "bb", None]), "source": source, "text": " ".join(rnd.choice(own) for _ in range(rnd.randint(0, 40)))})
    return rows


SCHEMA = "doc_id long, lang string, source string, text string"


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [{"doc_id": 1000, "lang": "cc", "source": None, "text": None}, {"doc_id": 1001, "lang": "cc", "source": "z", "text": "rare"}, {"doc_id": None, "lang": "one", "source": "o", "text": ""}]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10)
    assert {("cc", "", "pair", "z", 0, 1), ("cc", "z", "pair", "", 0, 1)} <= set(want)
    assert rows_of(m.source_divergence(df)) == want


def test_partial_counts_and_small_batches_give_the_same(spark, monkeypatch):
    rows = corpus(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    count = m.count_terms
    monkeypatch.setattr(m, "count_terms", lambda docs: count(docs, most=5))
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rows_of(m.source_divergence(df, least=3)) == brute(rows, 3)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tree_meets_each_ancestor_once():
    rnd = random.Random(5)
    zero, want, f = [rnd.randint(1, 9) for _ in range(6)], Counter(), lambda a, b: (a - b) ** 2 // (a + b)
    rows = sorted([(s, rnd.randint(1, 3), zero[s]) for s in range(6) if rnd.random() < 0.5] for _ in range(300))
    rows = [r for r in rows if r]
    terms = [rnd.randint(1, 3) for _ in rows]
    nodes = Counter()
    for row, n in zip(rows, terms):
        for j, (b, p, z) in enumerate(row):
            nodes[tuple(row[: j + 1])] += n
            for a, q, y in row[:j]:
                want[a, b] += n * (f(q, p) - f(q, z) - f(y, p) + f(y, z))
    flat = [np.array([e[k] for r in rows for e in r]) for k in range(3)]
    tree = m.PatternTree(*flat, np.cumsum([len(r) for r in rows]), np.array(terms))
    for k in range(6):
        first, below = tree.level(k)
        assert {tuple(rows[i][: k + 1]): n for i, n in zip(first, below)} == {path: n for path, n in nodes.items() if len(path) == k + 1}
    got = tree.corrections(6)
    assert {(i, j): int(got[i, j]) for i, j in zip(*np.nonzero(got))} == {k: v for k, v in want.items() if v}


def test_edges(spark):
    odd = spark.createDataFrame([(1, "aa", "s", "word " * 300_000, 5, "x"), (2, "aa", "t", "w" * 400_000, 6, "y")], f"{SCHEMA}, term int, value string")
    assert rows_of(m.source_divergence(odd, least=1)) == brute([r.asDict() for r in odd.collect()], 1)
    assert m.source_divergence(odd.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, None, "a", None)], SCHEMA)
    assert rows_of(m.source_divergence(nulls)) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_probabilities_of_very_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9 * 10**16 + 7, 3 * 10**18 + 1, 10**9
    got = spark.range(1).select(m.probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
