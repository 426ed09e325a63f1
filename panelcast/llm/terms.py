"""Terms of a text as runs of certain bytes, and their counts, in bounded memory.

Letters outside ASCII are several bytes of 128 and above, so a class of ASCII characters plus
all others is a class of bytes, and UTF-8 text can be cut into terms without being decoded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

SPACE = 0x20


def byte_table(digits: bool) -> bytes:
    """A translation of bytes: A-Z in lower case, other ASCII letters, all bytes from 128 and, if ``digits``, 0-9 as they are, the rest a space."""
    keep = {*range(0x61, 0x7B), *range(0x80, 0x100), *(range(0x30, 0x3A) if digits else ())}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else SPACE for b in range(256))


LETTERS, WORDS = byte_table(digits=False), byte_table(digits=True)


def terms(text: bytes, table: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of ``text`` in lists from about ``size`` bytes each; a term is never cut."""
    plain = text.translate(table)
    at = 0
    while at < len(plain):
        end = at + size
        if end < len(plain):
            gap = plain.find(b" ", end)
            end = len(plain) if gap < 0 else gap
        yield plain[at:end].split()
        at = end


def term_counts(text: bytes, table: bytes) -> Counter:
    """Occurrences of each term of ``text``."""
    found: Counter = Counter()
    for part in terms(text, table):
        found.update(part)
    return found
