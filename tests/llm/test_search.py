import math
import random
import re
from collections import Counter

import numpy as np
from panelcast.llm import search as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c, c.total()) for i, c in texts if c]
    n_docs, total, df = len(texts), sum(n for _, _, n in texts), Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in texts:
            mm = 100 - 90 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * mm)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, (i is not None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n=300):
    rnd = random.Random(8)
    words = ["Ärger", "tea2", "TEA2", "日本", "x_y", *("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 3))) for _ in range(50))]
    text = lambda most: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(9000 + i, docs[3][1]) for i in range(15)] + [(None, docs[4][1]), (None, docs[4][1]), (7, docs[7][1]), (9999, None)]  # ties, null ids, repeated rows
    items = [(i, text(12)) for i in range(30)] + [(100, docs[3][1]), (101, None), (102, "never seen"), (None, docs[4][1]), (100, docs[3][1])]
    rnd.shuffle(docs)
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows_of(m.search(d, i)) == want
    assert rows_of(m.search(d.repartition(5), i, doc_tile=7)) == want
    assert rows_of(m.search(d, i, k=1)) == brute(docs, items, 1)


def test_blocks_of_items_and_narrow_tiles_give_the_same(spark, monkeypatch):
    docs, items = corpus(80)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blocks, n = m._blocks, []

    def narrow(*args):
        for rows, block in blocks(*args):
            block.item_tile, block.width = 3, 2
            n.append(len(rows))
            yield rows, block

    monkeypatch.setattr(m, "_blocks", narrow)
    assert rows_of(m.search(d, i, most_bytes=300)) == brute(docs, items)
    assert len(n) > 3


def test_partial_sums_stay_exact():
    """Weights so large that only two terms may share a tile."""
    w = (m.EXACT - 1) // (m.MOST_IMPACT * 2)
    rng = np.random.default_rng(1)
    terms = [np.arange(40), np.array([3, 5])]
    block = m.Block({}, terms, np.full(40, w, np.int64) - rng.integers(0, 9, 40), 1, 1)
    doc, term = np.repeat(np.arange(6), 40), np.tile(np.arange(40), 6)
    impact = rng.integers(m.MOST_IMPACT // 2, m.MOST_IMPACT, 240)
    [(at, got)] = block.scores(doc, term, impact, 6)
    want = [[sum(int(block.weight[t]) * int(impact[d * 40 + t]) for t in own) for d in range(6)] for own in terms]
    assert at == 0 and got.tolist() == want and max(want[0]) > m.EXACT


def test_edges(spark):
    d = spark.createDataFrame([(1, "word " * 300_000 + "gold"), (2, "w" * 500_000), (3, "")], "doc_id long, text string").selectExpr("*", "1 as n", "2 as score", "3 as item_id")
    i = spark.createDataFrame([("a", "gold"), ("b", "word"), ("c", "")], "item_id string, text string").selectExpr("*", "4 as doc_id", "5 as rank")
    got = rows_of(m.search(d, i))
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [("a", "gold"), ("b", "word"), ("c", "")])
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id = 3"), i)):
        empty = m.search(a, b)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
