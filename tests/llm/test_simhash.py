import random

import pytest
import xxhash
from panelcast.llm import simhash as m
from pyspark.sql import functions as F


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and comp[j] > comp[i]:
                    comp[j] = comp[i]
                    changed = True
    return comp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_brute_force_and_spark_hash(spark):
    texts = [None, "", " \n", "One", "one two", "A b\tC d  e", "É à b C. x y z", "w " * 5000, "a b c d e f g h"]
    for t in texts:
        assert m.fingerprint(t) == brute_fp(t)
        assert m.fingerprint(t, step=2) == brute_fp(t)


@pytest.mark.parametrize("levels,cell_limit", [((6, 12), 1), ((6, 12), 5), ((6,), 5), ((6,), 1000)])
def test_links_find_every_component(spark, levels, cell_limit):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(170):
        x = rnd.choice(fps)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in m.components(m.links(df, levels, cell_limit)).collect()}
    of = [got.get(signed(x), signed(x)) for x in fps]
    pairs = {(a, b) for a, b in zip(of, want)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_embedding_is_a_lower_bound(spark):
    rnd = random.Random(1)
    rows = [(signed(rnd.getrandbits(64)),) for _ in range(50)]
    for fp, e in spark.createDataFrame(rows, "fp long").select("fp", m.embedding(F.col("fp"))).collect():
        u, v = fp % (1 << 64), e % (1 << 64)
        assert [bin(u >> 2 * s & 3).count("1") for s in range(32)] == [bin(v >> 2 * s & 3).count("1") for s in range(32)]


def test_groups_match_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
    rows = [(1, base), (2, base.upper()), (3, base + "lambda"), (4, None), (5, " "), (6, "solo words here now"), (None, base), (6, "solo words here now"), (7, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit(2))
    got = m.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    first = {}
    for (i, _), c in zip(rows, comp):
        first[c] = min([x for x in (first.get(c), i) if x is not None], default=None)
    want = sorted((str(i), f"{f:016x}", first[c]) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert m.simhash_groups(df.limit(0)).count() == 0
