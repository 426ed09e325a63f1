"""Token ids in binary files of patched frame-of-reference blocks.

File layout (little-endian)::

    b"PFB1"
    blocks, one after another:
        u32 n, u32 minimum, u8 width, u32 exceptions
        ceil(n * width / 8) bytes: the low ``width`` bits of id - minimum, first bit highest
        u32 position and u32 value for each exception (a value is id - minimum in full)
    documents: i64 id, u8 id is null, i64 tokens   for each document, in order
    block starts: u64 for each block
    footer: u64 documents, u64 blocks, u64 place of documents, u64 ids, b"PFB1"

The width of a block is that of a chosen percentile of its values, so a few large ids
don't widen the others; those ids are the exceptions.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, scratch

MAGIC = b"PFB1"
HEAD, FOOT = struct.Struct("<IIBI"), struct.Struct("<QQQQ4s")
BLOCK, PERCENTILE = 4096, 95.0
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")])


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    over = (ids - low).astype(np.uint32)
    at = min(len(over) - 1, int(len(over) * percentile / 100))
    width = int(np.partition(over, at)[at]).bit_length()
    outside = np.flatnonzero(over >> width) if width < 32 else np.empty(0, np.int64)
    span = 16 if width <= 16 else 32
    bits = np.unpackbits(over.astype(f">u{span // 8}").view(np.uint8)).reshape(-1, span)[:, span - width :]
    patches = np.empty((len(outside), 2), "<u4")
    patches[:, 0], patches[:, 1] = outside, over[outside]
    return HEAD.pack(len(ids), low, width, len(outside)) + np.packbits(bits).tobytes() + patches.tobytes()


def unpack_block(raw: bytes, at: int = 0) -> np.ndarray:
    n, low, width, k = HEAD.unpack_from(raw, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    span = 16 if width <= 16 else 32
    bits = np.zeros((n, span), np.uint8)
    bits[:, span - width :] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))[: n * width].reshape(n, width)
    out = np.packbits(bits).view(f">u{span // 8}").astype(np.uint32)
    patches = np.frombuffer(raw, "<u4", 2 * k, at + size).reshape(k, 2)
    out[patches[:, 0]] = patches[:, 1]
    return out + np.uint32(low)


class BlockWriter:
    """Writes documents one after another with memory for one block and the document index."""

    def __init__(self, out, block: int = BLOCK, percentile: float = PERCENTILE):
        self.out, self.block, self.percentile = out, block, percentile
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.place = 0
        self.docs: list[tuple] = []
        self.starts: list[int] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def _flush(self, all_: bool) -> None:
        joined = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        full = len(joined) if all_ else len(joined) // self.block * self.block
        for i in range(0, full, self.block):
            self.starts.append(self.place)
            self._put(pack_block(joined[i : min(i + self.block, full)], self.percentile))
        self.waiting, self.held = [joined[full:]], len(joined) - full

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        docs = self.place
        self._put(np.array(self.docs, DOC).tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(FOOT.pack(len(self.docs), len(self.starts), docs, self.ids, MAGIC))
        self.out.close()


def read_file(file, size: int) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """``doc_id, start, parts of ids`` of each document, a block at a time."""
    file.seek(size - FOOT.size)
    n_docs, n_blocks, place, _, magic = FOOT.unpack(file.read(FOOT.size))
    if magic != MAGIC:
        raise ValueError("not a token block file")
    file.seek(place)
    docs = np.frombuffer(file.read(n_docs * DOC.itemsize), DOC)
    starts = [*np.frombuffer(file.read(n_blocks * 8), "<u8").tolist(), place]
    block, at, k, start = np.empty(0, np.uint32), 0, 0, 0
    for doc_id, null, n in docs.tolist():
        parts, missing = [], n
        while missing:
            if at == len(block):
                file.seek(starts[k])
                block, at, k = unpack_block(file.read(starts[k + 1] - starts[k])), 0, k + 1
            part = block[at : at + missing]
            parts.append(part)
            at += len(part)
            missing -= len(part)
        yield (None if null else doc_id), start, parts
        start += n


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes the letters of Latin-1 beyond ASCII: a printable character for each UTF-8 byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(char[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if chr(c).isalpha()}


# fixed values: the rules under which a text may be cut into words between white space, as tokenizer files state them
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_at_blanks(tokenizer) -> bool:
    """Whether blanks only part words for this tokenizer: lower-casing, white space dropped, word ends marked, no special token but <...>."""
    rules = json.loads(tokenizer.to_str())
    norm, pre, model = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["model"]
    norms, steps = norm.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        [x["type"] for x in norms] == NORMALIZERS
        and (norms[1]["pattern"], norms[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and model["type"] == "BPE"
        and not model["dropout"]
        and not model["continuing_subword_prefix"]
        and not rules["truncation"]
        and not rules["padding"]
        and all(x["content"].startswith("<") and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"]) for x in rules["added_tokens"])
    )


class _Words(dict):
    """Blank-separated word -> its ids as packed u32, for words met before; emptied when full.

    Where the tokenizer lower-cases, drops white space and takes runs of letters as units, a word of
    Latin letters with a tail of marks has the ids of its lower-case letters, one unit which the
    tokenizer's model is asked for directly, and those of its tail.  Other words go to the library,
    and for tokenizers with other rules every text does, whole.
    """

    # letters of Latin-1, then ASCII marks without ' (contractions) and < (special tokens)
    LETTERS_TAIL = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,64})([!-&(-/:;=-@\[-`{-~]*)")

    def __init__(self, path: str, limit: int = 800_000):
        import tokenizers

        self.library, self.limit = tokenizers.Tokenizer.from_file(path), limit
        self.cuts = _cuts_at_blanks(self.library)
        self.units, self.letters = self.library.model.tokenize, _byte_letters()
        self.split, self.tails = self.LETTERS_TAIL.fullmatch, {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.split(word)
        if found is None:
            out = self.whole(word)
        else:
            low, tail = found.groups()
            low = low.lower()
            if low == word:
                packed = self.packed
                out = b"".join([packed[u.id] for u in self.units(word if word.isascii() else word.translate(self.letters))])
            else:
                out = self[low]
                if tail:
                    if (more := self.tails.get(tail)) is None:
                        more = self.whole(tail)
                        if len(tail) <= 8 and len(self.tails) < 100_000:
                            self.tails[tail] = more
                    out += more
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        # split() takes \x1c to \x1f as blanks, the tokenizer doesn't
        if not self.cuts or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def words(path: str) -> _Words:
    """One table for each Python worker."""
    return _Words(path)


def write_token_files(
    docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, most_bytes: int = 256 << 20
) -> DataFrame:
    """Encodes ``docs`` and writes files to the shared folder; a manifest ``shard, part, path, size, n_docs, n_ids``.

    Documents are dealt by ranges of their id, so shards in order hold ids in ascending
    order (null first, equal ids by a hash of the text, then the text; the hash parts them over
    shards, so rows without an id don't land in one task).  A task writes under names of its own
    and the manifest names the files that count, so tasks that ran twice do no harm.  It goes on in a new file,
    its next part, once one has ``most_bytes`` bytes, so a file and its index in memory have a bound.
    """
    folder = scratch(docs.sparkSession, "token-blocks")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, writer, end, nth = words(path), None, end_id.to_bytes(4, "little"), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if writer is None:
                        fs, top = pa.fs.FileSystem.from_uri(folder)
                        fs.create_dir(top)
                        name = f"{TaskContext.get().partitionId():06d}-{nth:04d}-{uuid.uuid4().hex}.pfb"
                        writer = BlockWriter(fs.open_output_stream(f"{top}/{name}"))
                    writer.add(doc_id, np.frombuffer(known.encode(text or "") + end, "<u4"))
                    if writer.place >= most_bytes:
                        yield closed(writer, name, nth)
                        writer, nth = None, nth + 1
        if writer:
            yield closed(writer, name, nth)

    def closed(writer: BlockWriter, name: str, nth: int) -> pa.RecordBatch:
        writer.close()
        shard = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pylist([{"shard": shard, "part": nth, "path": f"{folder}/{name}", "size": writer.place, "n_docs": len(writer.docs), "n_ids": writer.ids}])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("part"))
    dealt = rows.repartitionByRange(*([files] if files else []), "doc_id", "part").sortWithinPartitions("doc_id", "part", "text")
    return cut(dealt.mapInArrow(each, "shard long, part long, path string, size long, n_docs long, n_ids long"), "token-files")


def read_token_files(manifest: DataFrame, keep: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, with ``keep``, ``ids``, read from the files of a manifest.

    ``start`` counts the ids of all documents before, over all shards.
    """
    # one row a file: the running sum is over as many rows as there are files
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(f["path"])
                rows = []
                with fs.open_input_file(name) as file:
                    for doc_id, start, parts in read_file(file, f["size"]):
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                        rows.append((doc_id, f["before"] + start, n, crc) + ((np.concatenate(parts) if parts else [],) if keep else ()))
                        if len(rows) == 512:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * keep
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    n = max(1, manifest.count())
    return placed.repartition(n, "path").mapInArrow(
        each, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep
    )


def token_files(docs: DataFrame, path: str, keep: bool = True, **options) -> DataFrame:
    """Writes token files and reads them back: a row for each row of ``docs``.

    Null and empty texts have the end id alone.  Repeated rows are written again; null ids
    come first.  An empty table writes no file and gives an empty result; other columns are
    not read.
    """
    return read_token_files(write_token_files(docs, path, **options), keep)
