"""The pipeline's stages and the registered queries on small tables, against brute force."""

import hashlib
import os
import random

import duckdb
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelcast.llm import queries as Q
from tests.llm.test_simhash import brute_components, brute_fp

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Clean texts, exact copies, one near copy, toxic texts, null and empty texts, an extra column."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abdefgiklmnoprstu") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(60, 160)))
        if i % 6 == 0:
            at = text.split()
            at[10:10] = ["zzvile", "zznasty", "zzvile"]
            text = " ".join(at)
        rows.append((i, text))
        labels.append((i, int(i % 10 != 1), int(i % 6 == 0)))
    rows += [(1000, rows[1][1]), (1001, rows[1][1].replace(" ", "  ")), (1002, rows[2][1] + " tail"), (1003, None), (1004, ""), (1005, "x" * 30000)]
    d = str(tmp_path_factory.mktemp("docs"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit(1)).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    return f"file://{d}", dict(rows), {i for i, _, t in labels if t}


def test_stages_match_brute_force(spark, small):
    d, texts, toxic = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    ids = set(texts)

    docs = P.cut(P.STAGES[0][1](spark, docs, d), "t")
    now = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and now == ids - toxic

    docs = P.cut(P.STAGES[1][1](spark, docs, d), "t")
    groups = {}
    for i in now:
        groups.setdefault("".join((texts[i] or "").split()), []).append((-len(texts[i] or ""), i))
    now = {min(g)[1] for g in groups.values()}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == now

    docs = P.cut(P.STAGES[2][1](spark, docs, d), "t")
    order = sorted(now)
    comp = brute_components([brute_fp(texts[i]) for i in order])
    now = {order[c] for c in comp}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == now

    docs = P.cut(P.STAGES[3][1](spark, docs, d), "t")
    mixed = [r.doc_id for r in docs.collect()]
    assert docs.columns == columns and set(mixed) == now

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = P.STAGES[4][1](spark, docs, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(mixed)
    for r in got:
        listed = lib.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(listed) and r.ids_sha256 == hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()


def test_run_applies_all_stages(spark, small):
    assert set(P.run(spark, small[0]).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(Q.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.SQL)))
def test_other_queries_keep_every_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = Q.queries()[name](spark, DATA)
    assert got.count() == docs.count() and got.select("doc_id").distinct().count() == docs.count()


def test_stages_take_nulls_repeats_and_empty_tables(spark, small):
    d = small[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("text", F.when(F.col("doc_id") != 1, F.col("text")))
    for rows in (P.cut(odd, "t"), P.cut(docs.limit(0), "t")):
        nulls = rows.where("doc_id is null").count()
        for _, stage in P.STAGES[:4]:
            rows = P.cut(stage(spark, rows, d), "t")
            assert rows.columns == docs.columns and rows.where("doc_id is null").count() >= nulls
        P.STAGES[4][1](spark, rows, d).count()
