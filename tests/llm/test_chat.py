import random

import duckdb
from panelcast.llm import chat as m
from panelcast.llm import queries as q
from pyspark.sql import functions as F

HARD = ["<|im_end|>", "<\\|im_next|>", "\\<|", "<\\\\|x", "", None, "a\nb", "<|im_start|>assistant\nok<|im_end|>\n", "é🙂"]


def conversations():
    rnd = random.Random(3)
    rows = []
    for c in range(12):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "a\\n\nb", None]), rnd.choice(HARD) if c else "x" * 50000))
    return rows + [(None, 1, "user", "u"), (99, None, "assistant", "n"), (99, 1, "assistant", "n"), (99, 1, "assistant", "n")]


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = m.format_chats(df)
    back = {r.conv_id: r for r in m.read_chats(out).collect()}
    made = {r.conv_id: r for r in out.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    assert by.keys() == back.keys()
    for c, turns in by.items():
        got = [(t.role, t.text) for t in back[c].turns]
        assert sorted(got) == sorted((r, x) for _, r, x in turns)
        if len({k for k, _, _ in turns}) == len(turns):
            assert got == [(r, x) for _, r, x in sorted(turns)]
        at, loss = 0, ""
        for length, on in made[c].loss_mask:
            loss += made[c].formatted[at : at + length] if on else ""
            at += length
        assert at == len(made[c].formatted)
        assert spark.range(1).select(m.unescape(F.lit(loss)).alias("x")).first().x == back[c].loss_text
        assert back[c].loss_text == "".join(x for r, x in got if r == "assistant")
        # adjacent turns of one role share a block
        heads = made[c].formatted.count(m.START)
        assert heads == 1 + sum(a[0] != b[0] for a, b in zip(got, got[1:]))


def test_query_matches_sql_on_ties_and_nulls(spark, tmp_path):
    rows = [(1, None, "user", "last"), (1, 0, "user", "<z"), (1, 0, "user", "<|"), (1, 0, "user", "<\\|"), (1, 0, "<|r", "x"), (1, 0, "<zr", "x"), (1, 0, None, None), (1, 2, "a\\n\nb", "y")]
    rows += [(2, 1, "assistant", "é<|im_end|>"), (2, 1, "assistant", "é<|im_end|>"), (2, None, "assistant", ""), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (None, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = q.op7_chat_formatting(spark, f"file://{tmp_path}")
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({q.SQL['op7_chat_formatting']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
    assert len(want) == 6


def test_empty(spark):
    assert m.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
