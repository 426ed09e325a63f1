import random
import zlib

import numpy as np
import pytest
from panelcast.llm import language as m
from panelcast.llm import queries as q

DATA = "/root/testdata/sf0.001"


def corpus(spark, langs, n=1200, seed=3):
    rnd = random.Random(seed)
    parts = {x: ["".join(rnd.choice("aeioußéñдж"[i % 4 : i % 4 + 5] + "bcdfg") for _ in range(3)) for _ in range(25)] for i, x in enumerate(langs)}
    rows = []
    for i in range(n):
        lang = langs[min(int(rnd.expovariate(0.5)), len(langs) - 1)]
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(8, 60))]
        rows.append((i, " ".join(words).capitalize(), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("k", [2, 3, 4, 6, 7, 30])
def test_codes(k):
    code = m.code(k)
    assert set(np.unique(code)) == {-1, 1} and len({tuple(r) for r in code}) == k
    assert all(-k < s < k for s in code.sum(axis=0))  # every bit parts the languages
    if k <= 6:
        assert code.shape[1] == 2 ** (k - 1) - 1 and len({tuple(c) for c in code.T}) == code.shape[1]
        assert all((code[i] != code[j]).sum() == 2 ** (k - 2) for i in range(k) for j in range(i))
    else:
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert apart >= code.shape[1] / 4


def brute_slots(word, size):
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in m.SIZES for i in range(len(marked) - n + 1)]
    return [((int.from_bytes(g, "little") * 2654435761 + len(g) * 40503) % 2**32 >> 7) % size for g in grams]


def brute_evidence(model, text):
    """Without caches, pieces or byte tables."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = "".join(c if not c.isascii() or c.isalpha() else " " for c in low).split(" ")
    at = [s for w in words if w for s in brute_slots(w.encode(), len(model.table))]
    return sum((model.table[s] for s in at), np.zeros(model.table.shape[1])) / np.sqrt(max(len(at), 1))


def test_grams_by_definition():
    words = ["a", "été", "word", "日本語", "x" * 300]
    slot, word = m.grams([w.encode() for w in words], 1 << 12)
    for i, w in enumerate(words):
        assert sorted(slot[word == i]) == sorted(brute_slots(w.encode(), 1 << 12))


def test_words_beyond_the_limit_leave_after_use():
    table = np.random.default_rng(2).normal(size=(64, 3))
    words = m._Words(table)
    words.limit = 4
    for _ in range(3):
        for part in ([b"aa", b"bb", b"aa"], [b"cc", b"dd"], [b"ee", b"aa", b"ff"], [b"gg"]):
            want = [[*table[s].sum(axis=0), len(s)] for s in (brute_slots(w, 64) for w in part)]
            assert np.allclose(words.sums(part), want) and len(words) == len(words.rows) <= 4


@pytest.mark.parametrize("langs", [["aa", "bb", "cc", "dd"], [f"l{i}" for i in range(9)]])
def test_held_out_accuracy_and_scores_by_definition(spark, langs):
    rows, docs = corpus(spark, langs)
    model = m.fit_languages(docs, size=1 << 14)
    got = {r.doc_id: r for r in m.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 150 and sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    for i, text, _ in rows[:40]:
        e = brute_evidence(model, text)
        loss = {}
        for lang, word, weight in zip(model.langs, model.code, model.weight):
            loss[lang] = sum(w * np.log1p(np.exp(-b * (s + a * x))) for w, b, s, a, x in zip(weight, word, model.shift, model.slope, e))
        best = min(loss, key=loss.get)
        score = 1 / sum(np.exp(model.sharp * (loss[best] - v)) for v in loss.values())
        assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-9
        wrong = sum((s + a * x > 0) != (b > 0) for b, s, a, x in zip(model.code[model.langs.index(best)], model.shift, model.slope, e))
        assert got[i].ambiguous == (wrong > model.correctable() or score < model.least)


def test_training_never_sees_held_out_rows_or_other_columns(spark):
    rows, docs = corpus(spark, ["aa", "bb", "cc"], 600)
    flipped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a = m.fit_languages(docs, size=1 << 12)
    b = m.fit_languages(spark.createDataFrame(flipped, docs.schema).selectExpr("*", "1 as tries", "2 as n", "'x' as source"), size=1 << 12)
    assert a.langs == b.langs and np.array_equal(a.table, b.table) and np.array_equal(a.slope, b.slope)


def test_mixed_texts_are_ambiguous(spark):
    rows, docs = corpus(spark, ["aa", "bb", "cc", "dd"])
    model = m.fit_languages(docs, size=1 << 14)
    words = {lang: " ".join(t for _, t, x in rows if x == lang).split() for lang in model.langs}
    rnd = random.Random(1)
    mixed = [(i, " ".join(w for lang in model.langs for w in rnd.sample(words[lang], 3))) for i in range(100)]
    got = m.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    plain = m.identify(docs, model).collect()
    assert sum(r.ambiguous for r in got) > 40 and sum(r.ambiguous for r in plain) < 0.02 * len(plain)
    assert all(r.runner_up != r.lang_pred for r in got)


def test_edges(spark):
    rows, docs = corpus(spark, ["aa", "bb", "cc"], 300)
    model = m.fit_languages(docs, size=1 << 12)
    odd = [(None, None), (1, ""), (2, "12 %% 3\n"), (3, "é"), (3, "é"), (4, rows[0][1] * 3000), (5, "b" * 300_000), (6, "…—")]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as score", "'q' as lang_pred")
    got = m.identify(df, model).collect()
    assert len(got) == len(odd)
    for r, (i, text) in zip(got, odd):
        none = not any(c.isalpha() for c in text or "")
        assert r.doc_id == i and (r.lang_pred == m.UNKNOWN) == none and 0 <= r.score <= 1 and (not none or (r.score == 0 and not r.ambiguous and r.runner_up is None))
    assert got[5].lang_pred == rows[0][2]
    assert m.identify(df.limit(0), model).count() == 0
    no = m.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in m.identify(df, no).collect()} == {m.UNKNOWN}
    one = m.fit_languages(docs.where("lang = 'bb'"))
    assert {(r.lang_pred, r.score) for r in m.identify(df, one).collect()} == {(m.UNKNOWN, 0.0), ("bb", 1.0)}
    two = m.fit_languages(docs.where("lang <> 'cc'"), size=1 << 12)
    assert two.langs == ["aa", "bb"] and two.code.shape == (2, 1) and m.identify(df, two).count() == len(odd)


def test_pieces_of_long_texts_add_up(spark):
    rows, docs = corpus(spark, ["aa", "bb", "cc"], 300)
    model = m.fit_languages(docs, size=1 << 12)
    text = " ".join(t for _, t, _ in rows) * 20
    assert len(text) > 1 << 19
    assert np.allclose(model.evidence([b"", text.encode(), b"x"], at_once=1000)[1], brute_evidence(model, text))


def test_query(spark):
    got = q.op13_language(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
