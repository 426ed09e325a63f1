import hashlib

from panelcast.llm import exact_dedup as m
from pyspark.sql import functions as F


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\v\f\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {(i, min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


ROWS = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "ab "), (7, "x" * 30000 + ". y"), (8, "x" * 30000 + ".y"), (9, "é. " * 4000), (9, "é. " * 4000), (10, "AB")]


def test_matches_brute_force_with_extra_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("recipe", F.lit(1)).withColumn("norm", F.lit("z"))
    got = m.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(m.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = m.exact_dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(ROWS)


def test_empty_table(spark):
    assert m.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_join_to_the_text(spark):
    text = ("Word. " * 900 + "z" * 9000 + "! tail").replace(" ", "")
    got = spark.createDataFrame([(text,)], "t string").select(m.chunks(F.col("t")).alias("c")).first().c
    assert "".join(got) == text and max(map(len, got)) <= 4096
