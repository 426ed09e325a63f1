"""Personal data: fixed rules, and boosted trees over high-recall candidates.

The rules give base spans, which always stay.  Generators propose overlapping candidates,
looser than the rules: spelled-out e-mail addresses, numbers inside longer runs of digits,
national telephone numbers, IPv6.  Gradient-boosted trees score candidates by their format and
the characters around them; a threshold for each kind is calibrated for precision, and what
passes it is added where no base span of that kind is.

There are no labels for personal data, so training takes them from the rules: spans that the
rules accept are positive, candidates the rules reject are negative, and rewritten spans
(spelled-out addresses, changed check digits) teach what the rules don't say.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone")
log = logging.getLogger(__name__)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the same matches as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) in linear time: where no match starts with a run of digits, none starts inside it
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT = r"(?:@|\(at\)|\[at\]|\x20at\x20)"
DOT = r"(?:\.|\(dot\)|\[dot\]|\x20dot\x20)"
SPELLED = re.compile(rf"{AT}\x20?[A-Za-z0-9-]+(?:\x20?{DOT}\x20?[A-Za-z0-9-]+)+")
LOOSE = (
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])00[0-9]{1,3}[\x20.-][0-9][0-9\x20().-]{5,}[0-9](?![0-9])")),
)
CONTEXT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
}


def digits(text: str) -> str:
    return re.sub(r"[^0-9]+", "", text)


def octet(part: str) -> bool:
    """Whether a run of ASCII digits is 255 at most; as text, since a run may be longer than an int can be read from."""
    short = part.lstrip("0")
    return len(short) <= 3 and (not short or short.isascii() and short.isdigit() and int(short) <= 255)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def accepted(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern passes its rule."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(octet, text.split(".")))
    n = digits(text)
    return (16 <= len(n) <= 19 and luhn(n)) if kind == "card" else 8 <= len(n) <= 15


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Found from each @ leftwards, which takes linear time where a search from each start would not.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """Leftmost non-overlapping matches of each kind, with whether the rule accepts them."""
    kinds = []
    if DIGIT.search(text):
        kinds = [("ip", IP)] * (text.count(".") >= 3) + [("card", CARD)] + [("phone", PHONE)] * ("+" in text)
    found = [("email", s, e, True) for s, e in addresses(text)]
    return found + [(k, m.start(), m.end(), accepted(k, m.group())) for k, p in kinds for m in p.finditer(text)]


def candidates(text: str) -> list[tuple[str, int, int]]:
    some_at = "@" in text or "(at)" in text or "[at]" in text or (" at " in text and " dot " in text)
    some_digit = DIGIT.search(text) is not None
    found = {(kind, m.start(), m.end()) for kind, pattern in LOOSE if some_digit for m in pattern.finditer(text)}
    last = 0
    for m in SPELLED.finditer(text) if some_at else ():
        at = start = m.start() - (m.start() > last and text[m.start() - 1] == " ")
        while start > last and LOCAL.match(text[start - 1]):  # to the end of the match before at most, so in linear time
            start -= 1
        if start < at:
            found.add(("email", start, m.end()))
        last = m.end()
    return sorted(found)


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format of the span and the characters around it (30 before, 10 after)."""
    runs = [len(x) for x in re.findall(r"[0-9]+", span)]
    n = digits(span)
    parts = span.split(".")
    near = before.lower()
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(n)),
        float(len(runs)),
        float(max(runs, default=0)),
        float(min(runs, default=0)),
        float(sum(c in " -" for c in span)),
        float(span.count(".")),
        float(len(re.findall(AT, span))),
        float("(" in span),
        float(span.startswith("+")),
        float(bool(n) and luhn(n)),
        float(len(parts) == 4 and all(p and octet(p) for p in parts)),
        float(span.count(":") == 7),
        float(bool(re.search(rf"{DOT}\x20?[A-Za-z]{{2,}}$", span))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(any(w in near for w in CONTEXT[kind])),
        float(len(set(n))),
    ]


def rewritten(kind: str, span: str) -> list[tuple[str, int]]:
    """Training examples made from an accepted span: (text, label)."""
    if kind == "email":
        user, _, host = span.partition("@")
        return [(f"{user} (at) {host}", 1), (f"{user}[at]{host.replace('.', '[dot]')}", 1), (f"{user} at {host.replace('.', ' dot ')}", 1), (f"{user} at {host.split('.')[0]}. {user}", 0)]
    if kind == "ip":
        first, *rest = parts = span.split(".")
        a, b, c, d = (int(x.lstrip("0") or 0) for x in parts)
        return [(".".join([str(a + 256), *rest]), 0), (f"2001:db8:{a:x}:{b:x}:{c * 257:x}:0:{a * 256 + d:x}:{d:x}", 1), (f"2002:{a:02x}{b:02x}:{c:02x}{d:02x}:{b * 97:x}:{d:x}:{c:x}:{b:x}:{a:x}", 1)]
    if kind == "card":
        n = digits(span)
        wrong = n[:-1] + str((int(n[-1]) + 3) % 10)
        return [("-".join(n[i : i + 4] for i in range(0, len(n), 4)), 1), (wrong, 0), ("-".join(wrong[i : i + 4] for i in range(0, len(n), 4)), 0)]
    n = digits(span)[-10:]
    return [(f"({n[:3]}) {n[3:6]}-{n[6:]}", 1), (f"+1-{n[:3]}-{n[3:6]}-{n[6:]}", 1), (f"+{n}{n}", 0)] if len(n) == 10 else []


BINS = 10_000  # of scores
SPAN = "struct<kind:string,start:int,end:int>"
SCORED = "struct<kind:string,start:int,end:int,features:array<double>,label:int>"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ARROW_SCORED = pa.struct([*_ARROW_SPAN, ("features", pa.list_(pa.float64())), ("label", pa.int32())])


def _inspect(text: str | None) -> tuple[list, list]:
    """Base spans, and candidates with features; label 1 or 0 where training may use it, -1 where unknown, starts of -1 for rewritten spans."""
    text = text or ""
    matches = base_matches(text)
    base = [(k, s, e) for k, s, e, ok in matches if ok]
    known, found, places = set(base), [], {(k, s, e) for k, s, e, _ in matches}
    failed = {kind: sorted((s, e) for k, s, e, ok in matches if k == kind and not ok) for kind in KINDS}  # they don't overlap
    for k, s, e in candidates(text):
        before = bisect_right(failed[k], (s, len(text)))
        inside_failed = before > 0 and e <= failed[k][before - 1][1]
        exactly = (k, s, e) in places
        label = 1 if (k, s, e) in known else -1 if (inside_failed and not exactly) or k in ("email", "phone") or ":" in text[s:e] else 0
        found.append((k, s, e, features(k, text[s:e], text[max(0, s - 30) : s], text[e : e + 10]), label))
    for k, s, e in base:
        for span, label in rewritten(k, text[s:e]):
            found.append((k, -1, -1, features(k, span, text[max(0, s - 30) : s], text[e : e + 10]), label))
    return base, found


def inspect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, base, found`` for each row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_span, as_scored = (lambda x: dict(zip(("kind", "start", "end"), x))), (lambda x: dict(zip(("kind", "start", "end", "features", "label"), x)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_inspect(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([[as_span(x) for x in b] for b, _ in rows], pa.list_(_ARROW_SPAN)),
                        pa.array([[as_scored(x) for x in f] for _, f in rows], pa.list_(_ARROW_SCORED)),
                    ],
                    ["doc_id", "base", "found"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = rows.mapInArrow(each, f"doc_id long, base array<{SPAN}>, found array<{SCORED}>")
    return cut(seen.select(F.monotonically_increasing_id().alias("row"), "*"), "pii-candidates")


def added_spans(seen: DataFrame, max_training: int = 20_000, precision: float = 0.99, trees: int = 12, depth: int = 4) -> DataFrame:
    """``row, added``: candidates above the calibrated threshold of their kind, as arrays by row.

    Trains on about ``max_training`` labelled candidates at most, as many of each kind and label, chosen
    by a hash of document, place and format, and never on more than two thirds of those there are.  All
    other labelled candidates calibrate the thresholds, from counts by score: the lowest at which
    precision is at least ``precision``, each label weighted for what training took of it.
    """
    each = seen.where(F.size("found") > 0).select("row", "doc_id", F.posexplode("found").alias("at", "c")).select("row", "doc_id", "at", "c.*")
    vectors = each.withColumn("features", array_to_vector("features"))
    labelled = each.where("label >= 0")
    known = {(r.kind, r.label): r["count"] for r in labelled.groupBy("kind", "label").count().collect()}  # two a kind
    none = seen.select("row", F.array().cast(f"array<{SPAN}>").alias("added")).limit(0)
    if len({label for _, label in known}) < 2:
        return none
    share = F.create_map(*[F.lit(x) for (k, y), n in known.items() for x in (f"{k}{y}", min(2 / 3, max_training / (2 * len(KINDS)) / n))])
    place = F.pmod(F.xxhash64("doc_id", "start", "at", "features"), F.lit(1 << 30)) / float(1 << 30)
    labelled = labelled.withColumn("trains", place < share[F.concat("kind", F.col("label").cast("string"))])
    fitted = cut(labelled.where("trains").select("features", "label"), "pii-training")
    if fitted.select("label").distinct().count() < 2:
        return none
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=1).fit(
        fitted.select(array_to_vector("features").alias("features"), "label").coalesce(1).cache()  # a bounded sample
    )
    prob = vector_to_array("probability")[1]
    score = F.floor(prob * BINS).cast("int")
    trial = model.transform(labelled.where("not trains").withColumn("features", array_to_vector("features"))).groupBy("kind", "label", score.alias("bin")).count().collect()  # at most 2 x BINS a kind
    left = Counter()
    for r in trial:
        left[r.kind, r.label] += r["count"]
    limits = {}
    for kind in KINDS:
        at = Counter()
        for r in trial:
            if r.kind == kind:
                at[r.bin, r.label] += r["count"] * known[kind, r.label] / left[kind, r.label]
        right = every = 0.0
        for score_ in sorted({b for b, _ in at}, reverse=True):
            right += at[score_, 1]
            every += at[score_, 0] + at[score_, 1]
            if right >= precision * every:
                limits[kind] = max(score_, BINS // 2)
        if kind in limits:
            passed = {y: sum(n for (b, label), n in at.items() if label == y and b >= limits[kind]) for y in (0, 1)}
            positive = sum(n for (_, label), n in at.items() if label == 1)
            log.info(
                "personal data, %s: threshold %.4f, held-out precision %.4f, recall %.4f of %d", kind, limits[kind] / BINS, passed[1] / max(sum(passed.values()), 1e-9), passed[1] / max(positive, 1e-9), positive
            )
    if not limits:
        return none
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("kind")]
    passed = model.transform(vectors.where("start >= 0")).withColumn("p", prob).where(score >= limit)
    return passed.groupBy("row").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("o"), (-F.col("p")).alias("p"), "start", "end", "kind"))),
            lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
        ).alias("added")
    )


def _merged(base: list[dict], added: list[dict]) -> list[dict]:
    """``base`` and those of ``added``, in their order, that overlap no span of their kind so far; by kind, then start."""
    taken = {k: sorted((x["start"], x["end"]) for x in base if x["kind"] == k) for k in KINDS}
    for a in added:
        of_kind = taken[a["kind"]]
        at = bisect_right(of_kind, (a["start"], a["end"]))
        if (not at or of_kind[at - 1][1] <= a["start"]) and (at == len(of_kind) or a["end"] <= of_kind[at][0]):
            insort(of_kind, (a["start"], a["end"]))
    return [{"kind": k, "start": s, "end": e} for k in KINDS for s, e in taken[k]]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``(kind, start, end)`` in code points, by kind as in ``KINDS``, then start.

    ``base`` are the rules' spans; ``spans`` adds those the trees accept, the longest first, then the most
    probable, where no span of that kind is yet.  A row for each row of ``docs``, repeated rows and null ids included;
    null texts are empty; an empty table gives an empty result; other columns are not read.
    """
    seen = inspect(docs, id_col, text_col)
    joined = seen.select("row", "doc_id", "base").join(added_spans(seen, **options), "row", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(_merged(base, added or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(_ARROW_SPAN))], ["doc_id", "base", "spans"])

    return joined.select("doc_id", "base", "added").mapInArrow(each, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def listed(spans: str):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: str, spans: list) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the earliest, then longest, wins."""
    out, at = [], 0
    for k, s, e in sorted(((x["kind"], x["start"], x["end"]) for x in spans), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join([*out, text[at:]])
