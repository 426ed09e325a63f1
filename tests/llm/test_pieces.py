import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from panelcast.llm import pieces as m
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  ", "   a", "a ", "a  ", "\n", "\n\n a\n", " \n ", "▁x ▁", "\x00a", "<s>hi</s><unk><0x0A>", "日本🙂 x🙂🙂", "é é Ａ", "a\tb\r\nc",
    " " * 40 + "x" + " " * 17, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "www.example.com/x?y=1&z=[2]", "the" * 3000, "².", "== ==== ======= ----------",
]


@pytest.fixture(scope="module")
def both():
    return m.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_hard_texts(both):
    own, lib = both
    for t in HARD:
        ids = lib.encode(t or "")
        assert own.encode(t or "") == ids, t
        assert own.decode(ids) == lib.decode(ids), t


def test_random_texts(both):
    own, lib = both
    rnd = random.Random(2)
    some = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(4000):
        kind = rnd.random()
        if kind < 0.4:
            t = "".join(rnd.choice(some) for _ in range(rnd.randint(1, 12)))
        elif kind < 0.7:
            t = "".join(rnd.choice("aeionrstlhd .,\n-_éñ") for _ in range(rnd.randint(1, 60)))
        else:
            t = "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x500), rnd.randint(0x3040, 0x9FFF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(rnd.randint(1, 20)))
        assert own.encode(t) == lib.encode(t), t
        ids = [rnd.randrange(32000) for _ in range(rnd.randint(1, 9))] if kind < 0.3 else lib.encode(t)
        assert own.decode(ids) == lib.decode(ids), ids
    for _ in range(500):
        ids = [rnd.randrange(3, 259) for _ in range(rnd.randint(1, 9))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_memory_limits_keep_results(both):
    _, lib = both
    small = m.PieceModel(PATH)
    small.fits.limit = small.after_blank.limit = small.bare.limit = 3
    t = "Some words repeat and some words do not.\nSome words " * 5
    assert small.encode(t) == lib.encode(t)


def test_query_rows(spark, both):
    _, lib = both
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "x"), (3, "   a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = m.encode_decode(df, PATH).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(map(str, want))
    assert m.encode_decode(df.limit(0), PATH).count() == 0
