import base64
import hashlib
import io

from panelcast.llm import warc as m
from pyspark.sql import functions as F

ROWS = [
    (5, "http://a.example/x", "<p>é</p>"), (2, "http://b.example/\r\ny z", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (3, "u", ""), (4, "v", "x\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "w", "long " * 300000), (7, "w", "long " * 300000), (8, "w", "other"), (None, "w", "other"), (8, "w", "third"), (2, "again", "<p>é</p>"), *[(None, "n", f"no id {i}") for i in range(40)],
]


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        back = i is not None and len(raw) >= least and first[h or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if back else "response", first[h or ""] if back else None))
    return sorted(map(str, out))


def test_matches_brute_force(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("n", F.lit(1))
    for least in (0, 6):
        got = m.warc_transactions(pages, least).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == brute(ROWS, least)
        assert {r.n_requests for r in got} == {1}
    assert m.warc_transactions(pages.limit(0)).count() == 0


def test_files_roll_over_by_size(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    files = m.write_warc(pages, most_bytes=2000).collect()
    assert len(files) > 8 and all(f.size < 4000 or f.records <= 9 for f in files)
    assert sum(f.records for f in files) == 3 * len(ROWS)
    assert sorted(str(tuple(r)[:5]) for r in m.warc_transactions(pages, most_bytes=2000).collect()) == brute(ROWS, 0)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(ROWS[:8], "page_id long, url string, html string")
    got = m.assemble(m.read_records(m.write_warc(pages))).where("response.type = 'response'").collect()
    assert {r.metadata[0].fields["page-id"]: bytes(r.response.payload).decode() for r in got} == {str(i): h or "" for i, _, h in ROWS[:8] if i in (2, 1, 4, 6)}


def test_members_across_chunks():
    raw = b"".join(m.capture_records(1, 0, "http://x/", b"p" * 5000, None, "d"))
    for chunk, step in ((1, 1), (7, 3), (1000, 64), (1 << 20, 1 << 14)):
        kinds = [m.parse_record(r)["type"] for r in m.members(io.BytesIO(raw), chunk, step)]
        assert kinds == ["request", "response", "metadata"]
