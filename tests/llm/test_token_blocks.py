import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from panelcast.llm import token_blocks as m
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " ", "Hello, World.", "it's IT'S we'LL", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "É à. ÑÑ, ß µ. Ω.", "é x.́ y",
    "a\x1cb c\x85d e f", "1.5 a.b .a. a., (a.) ...", "日本語 🙂🙂.", "x" * 20000, "word. " * 3000, "İ I. İ.", "A.\n\nB,\tC",
]


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("ids", [[5], [0] * 10, list(range(5000)), [1] * 4000 + [49000] * 50, [7, 2**32 - 1], [3, 2**20] * 300])
def test_block_round_trip(ids):
    a = np.array(ids, np.uint32)
    for p in (1.0, 50.0, 95.0, 100.0):
        assert (m.unpack_block(m.pack_block(a, p)) == a).all()


def ids_of(known, text):
    return np.frombuffer(known.encode(text), "<u4").tolist()


def test_words_match_the_library(library):
    known = m._Words(PATH, limit=50)
    for t in HARD:
        assert ids_of(known, t or "") == library.encode(t or "", add_special_tokens=False).ids, t
    rnd = random.Random(4)
    for _ in range(3000):
        t = "".join(rnd.choice("abCDéÀÿ÷.,' <|>1\ńßΣ") for _ in range(rnd.randint(1, 25)))
        assert ids_of(known, t) == library.encode(t, add_special_tokens=False).ids, t


def test_tokenizers_with_other_rules_take_whole_texts():
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    known, lib = m._Words(path), tokenizers.Tokenizer.from_file(path)
    assert not known.cuts and m._Words(PATH).cuts
    for t in [x or "" for x in HARD] + ["Hello World, it's fine."]:
        assert ids_of(known, t) == lib.encode(t, add_special_tokens=False).ids, t


def test_file_round_trip():
    rnd = np.random.default_rng(1)
    docs = [(i if i != 3 else None, rnd.integers(0, 50000, n).astype(np.uint32)) for i, n in enumerate([0, 1, 10, 5000, 0, 300, 9000])]

    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    w = m.BlockWriter(out, block=256)
    for d in docs:
        w.add(*d)
    w.close()
    start = 0
    for (i, ids), (j, s, parts) in zip(docs, m.read_file(out, w.place), strict=True):
        assert i == j and s == start and (np.concatenate([*parts, []]) == ids).all()
        start += len(ids)


def test_files_match_brute_force(spark, library):
    rows = [(i * 7 % 31, t) for i, t in enumerate(HARD)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("path", F.lit(1))
    start, want = 0, []
    part = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], part(r[1]))):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = m.token_files(df, PATH, files=4).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got), key=lambda r: r[1]) == want
    assert m.token_files(df.limit(0), PATH).count() == 0


def test_files_roll_over_by_size(spark, library):
    df = spark.createDataFrame([(i, f"word{i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    files = m.write_token_files(df, PATH, files=2, most_bytes=1000).collect()
    assert len(files) > 4 and {f.shard for f in files} == {0, 1} and sum(f.n_docs for f in files) == 300
    assert all([f.part for f in sorted(files, key=lambda f: f.part) if f.shard == s] == list(range(sum(f.shard == s for f in files))) for s in (0, 1))
    got = lambda **o: sorted(map(str, m.token_files(df, PATH, files=2, **o).collect()))
    assert got(most_bytes=1000) == got()


def test_rows_without_ids_are_spread_over_files(spark, library):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    shards = m.write_token_files(df, PATH, files=4).collect()
    assert len(shards) == 4 and max(r.n_docs for r in shards) < 250
    part = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    sizes = [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in sorted((f"text {i}" for i in range(400)), key=part)]
    assert sorted(r.start for r in m.token_files(df, PATH, files=4).collect()) == [sum(sizes[:i]) for i in range(400)]
