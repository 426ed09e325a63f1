"""SentencePiece encoding and decoding for merge-type (BPE) models.

A text is cut into segments that no piece of the vocabulary can cross (before blanks
and around line feeds).  A segment is encoded by backtracking: an Aho-Corasick pass
gives the longest piece at each position; a piece is taken if it fits the one before,
that is, if merging the two pieces' characters anew gives the same two pieces; where
nothing fits, the position is marked as failed and the last piece is replaced by its
next shorter prefix.  The result is the one sequence that merging would give.

Characters without a piece are written as their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class _Fits(dict):
    """(piece before or "", piece) -> whether the two stand side by side in a merged text."""

    def __init__(self, merge, limit: int = 400_000):
        self.merge, self.limit = merge, limit

    def __missing__(self, pair):
        if len(self) >= self.limit:
            self.clear()
        before, piece = pair
        self[pair] = out = self.merge(before + piece) == ([before, piece] if before else [piece])
        return out


class _Shorter(dict):
    """Piece -> its longest proper prefix that is a piece or one character; "" for one character."""

    def __init__(self, pieces: dict, limit: int = 100_000):
        self.pieces, self.limit = pieces, limit

    def __missing__(self, piece):
        if len(self) >= self.limit:
            self.clear()
        self[piece] = out = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.pieces), "")
        return out


class _Known(dict):
    """Segment -> ids, for segments met before; emptied when full, so memory is bounded.

    ``marks`` are characters that no piece joins to an ASCII letter before them, so a mark at
    the end of a word is encoded on its own and the word is shared with its bare form.
    """

    def __init__(self, encode, before: str, marks: dict[str, tuple], limit: int = 400_000):
        self.encode, self.before, self.marks, self.limit = encode, before, marks, limit

    def __missing__(self, word):
        if len(word) > 1 and word[-1] in self.marks and word[-2].isascii() and word[-2].isalpha():
            out = self[word[:-1]] + self.marks[word[-1]]
        else:
            out = tuple(self.encode(self.before + word)) if self.before + word else ()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


class PieceModel:
    """Encoder and decoder of one model file.  Blanks stand for the model's blank mark inside."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {sp.id_to_piece(i).replace(MARK, " "): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        crossing = [p for p in self.id_of if re.search(r"[^ ] |\n", p)]
        if crossing or not self.byte_id:
            raise ValueError(f"segments can't be cut for this model: {crossing[:3]}")
        self.matcher = ahocorasick.Automaton()
        for p in self.id_of:
            self.matcher.add_word(p, len(p))
        self.matcher.make_automaton()
        self.fits = _Fits(self.merge)
        self.shorter = _Shorter(self.id_of)
        marks = {c: self._ids(c) for c in ".,;:!?" if not any(re.search(rf"[A-Za-z]{re.escape(c)}", p) for p in self.id_of)}
        self.after_blank, self.bare = _Known(self.segment, " ", marks), _Known(self.segment, "", marks)
        self.line_feed = self._ids("\n")
        # decoding tables; unknown and control ids as the library writes them
        self.bytes_of = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
            else b" \xe2\x81\x87 " if sp.is_unknown(i)
            else b"" if sp.is_control(i)
            else sp.id_to_piece(i).replace(MARK, " ").encode()
            for i in ids
        ]
        self.is_byte = [sp.is_byte(i) for i in ids]
        self.decimal = [b"%d" % i for i in ids]

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: the best score first, the leftmost on ties."""
        parts = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _ids(self, piece: str) -> tuple[int, ...]:
        found = self.id_of.get(piece)
        return (found,) if found is not None else tuple(self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass"))

    def segment(self, text: str) -> list[int]:
        """Ids of a text that is encoded as one piece of work, by backtracking."""
        n, fits, shorter = len(text), self.fits, self.shorter
        longest = [1] * n
        for end, length in self.matcher.iter(text):
            longest[end - length + 1] = length  # ends come in ascending order, so the longest is set last
        failed = bytearray(n + 1)
        taken: list[str] = []
        at, piece = 0, text[: longest[0]]
        while at < n:
            before = taken[-1] if taken else ""
            while piece:
                if not failed[at + len(piece)] and fits[before, piece]:
                    break
                piece = shorter[piece]
            if piece:
                taken.append(piece)
                at += len(piece)
                piece = text[at : at + longest[at]] if at < n else ""
            else:
                failed[at] = 1
                piece = taken.pop()
                at -= len(piece)
        id_of = self.id_of
        try:
            return [id_of[p] for p in taken]
        except KeyError:
            return [i for p in taken for i in self._ids(p)]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        lines = text.replace(MARK, " ").split("\n")
        for k, line in enumerate(lines):
            words = line.split(" ")
            if k:
                out.extend(self.line_feed)
                out.extend(self.bare[words[0]])
                words = words[1:]
            if "" in words:  # runs of blanks belong to the word after them
                joined, blanks = [], 0
                for w in words:
                    if w:
                        joined.append(" " * blanks + w)
                        blanks = 0
                    else:
                        blanks += 1
                out.extend(chain.from_iterable(map(self.after_blank.__getitem__, joined)))
                if blanks:
                    out.extend(self.segment(" " * blanks))
            else:
                out.extend(chain.from_iterable(map(self.after_blank.__getitem__, words)))
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if ids and not self.is_byte[ids[0]]:
            raw = raw.removeprefix(b" ")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte pieces that aren't UTF-8: every byte outside a valid character gives U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                size = next((n for n in range(1, 5) if _valid(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        text = "".join(out)
        return text if self.is_byte[ids[0]] else text.removeprefix(" ")


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def model(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    One row per row of ``docs``, repeated rows and null ids included; null texts are
    empty and have no ids.  No begin or end ids.  Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_row(m, t, keep) for t in part.column(1).to_pylist()]
                cols = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = ", ids array<int>, decoded string" if keep else ""
    return rows.mapInArrow(each, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def _row(m: PieceModel, text: str | None, keep: bool) -> tuple:
    ids = m.encode(text or "")
    listed = hashlib.sha256(b",".join(map(m.decimal.__getitem__, ids))).hexdigest()
    decoded = m.decode(ids)
    digests = len(ids), listed, hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
    return (*digests, ids, decoded) if keep else digests
