"""Words of UTF-8 texts by byte translation: one 256-byte table, then ``bytes.split``.

The table lower-cases A-Z and blanks what separates words, so a text becomes words without
decoding it. Long texts are split piece by piece, so the words of a piece are all that is
held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakescope.llm.words import ALNUM, NONSPACE

PIECE = 1 << 20  # bytes split at once


def table(word_bytes: np.ndarray) -> bytes:
    """Maps A-Z to a-z and every byte outside ``word_bytes`` to a space."""
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if word_bytes[b] else 0x20 for b in range(256))


ALNUM_TABLE = table(ALNUM)
NONSPACE_TABLE = table(NONSPACE)


def word_lists(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words in order, as lists of those of about ``piece`` bytes of text; none for a text without words."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + piece, n)
        part = text[at:end].translate(table)
        open_ = b"" if end == n else part[part.rfind(b" ") + 1 :]  # a word that may go on
        done = part[: len(part) - len(open_)]
        if open_ and not done:  # a word longer than a piece: take it whole
            tail = [open_]
            while end < n and b" " not in tail[-1]:
                at, end = end, min(end + piece, n)
                tail.append(text[at:end].translate(table))
            whole = b"".join(tail)
            if end < n:
                end -= len(whole) - whole.rfind(b" ") - 1
                whole = whole[: whole.rfind(b" ")]
            done, open_ = whole, b""
        words = done.split()
        if words:
            yield words
        at = end - len(open_)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_string()).view(pa.large_binary()).to_pylist()


def as_text(values: list[bytes]) -> pa.Array:
    """A string column of UTF-8 bytes."""
    return pa.array(values, pa.binary()).view(pa.string())
