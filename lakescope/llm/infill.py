"""Fill-in-the-middle documents by rotating blocks inside one byte buffer.

A text is cut into prefix, middle and suffix at two code points drawn from a hash of its
id. The three sentinels are put before the blocks of one bytearray, which gives
``<P>prefix<M>middle<S>suffix``; exchanging two neighbouring blocks makes the wanted form:

* ``psm``: ``<P>prefix<S>suffix<M>middle`` exchanges the second and the third block,
* ``spm``: ``<S>suffix<P>prefix<M>middle`` exchanges the first two with the third.

Two neighbours are exchanged by three reversals (each, then both together), in place and
with buffers of fixed size. ``restore`` finds the sentinels, inverts the rotation the same
way and takes the sentinels out, which gives the text back byte for byte.

Texts are ``plain`` (unchanged) if empty, if they contain a sentinel, or by the draw. As no
sentinel is in a cut text and none overlaps with another, each is found at one place only.

Defined cases: a null text is empty, so plain; a null id is drawn by the hash of the prefix
alone; rows that repeat are transformed each, alike; an empty table gives no rows; only id
and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm.byte_words import as_text, raw
from lakescope.llm.words import pieces

BLOCK = 1 << 16  # bytes swapped or scanned at once
FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Plan(NamedTuple):
    """Sentinels before prefix, suffix and middle; per cent of texts cut; per cent of those in suffix-first form."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    cut: int = 90
    suffix_first: int = 20
    seed: str = "1:"


PLAN = Plan()


def draws(doc_id: int | None, seed: str = PLAN.seed) -> list[int]:
    """Four unsigned 32-bit numbers from the id."""
    digest = hashlib.sha256((seed + ("" if doc_id is None else str(doc_id))).encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _starts(block: np.ndarray) -> np.ndarray:
    return (block & 0xC0) != 0x80


def n_chars(text: bytes) -> int:
    """Code points of a UTF-8 text."""
    data = np.frombuffer(text, dtype=np.uint8)
    return sum(int(np.count_nonzero(_starts(data[i : i + BLOCK]))) for i in range(0, len(data), BLOCK))


def byte_places(text: bytes, chars: list[int]) -> list[int]:
    """Where code points (ascending numbers, the text's length allowed) start, by one scan."""
    data, out, seen, at = np.frombuffer(text, dtype=np.uint8), [], 0, 0
    while at < len(data) and len(out) < len(chars):
        first = np.flatnonzero(_starts(data[at : at + BLOCK]))
        while len(out) < len(chars) and chars[len(out)] < seen + len(first):
            out.append(at + int(first[chars[len(out)] - seen]))
        seen, at = seen + len(first), at + BLOCK
    return out + [len(data)] * (len(chars) - len(out))


def reverse(view: np.ndarray, i: int, j: int) -> None:
    """Reverse bytes i to j in place, by swapping blocks from both ends."""
    while j - i > 1:
        size = min(BLOCK, (j - i) // 2)
        left = view[i : i + size].copy()
        view[i : i + size] = view[j - size : j][::-1]
        view[j - size : j] = left[::-1]
        i, j = i + size, j - size


def exchange(buffer: bytearray, i: int, m: int, j: int) -> None:
    """Make the neighbours i to m and m to j change places."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, i, m)
    reverse(view, m, j)
    reverse(view, i, j)


def rotate(text: bytes, cuts: tuple[int, int], form: str, plan: Plan = PLAN) -> bytearray:
    """The text cut at two bytes, in the form asked for."""
    a, b = cuts
    buffer = bytearray(text)
    for at, mark in ((b, plan.suffix), (a, plan.middle), (0, plan.prefix)):
        buffer[at:at] = mark
    middle = a + len(plan.prefix)
    suffix = b + len(plan.prefix) + len(plan.middle)
    exchange(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restored(output: bytes, form: str, plan: Plan = PLAN) -> bytes:
    """The text that ``rotate`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    p, s, m = (buffer.find(mark) for mark in (plan.prefix, plan.suffix, plan.middle))
    if form == "psm":  # P S M: the blocks behind the prefix change back
        exchange(buffer, s, m, len(buffer))
        m, s = s, s + len(buffer) - m
    else:  # S P M: the suffix goes back behind the others
        exchange(buffer, 0, p, len(buffer))
        m, s, p = m - p, len(buffer) - p, 0
    for at, mark in ((s, plan.suffix), (m, plan.middle), (p, plan.prefix)):
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def transform(doc_id: int | None, text: bytes, plan: Plan = PLAN) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle, and the transformed text."""
    n, (h1, h2, h3, h4) = n_chars(text), draws(doc_id, plan.seed)
    if not text or h3 % 100 >= plan.cut or any(mark in text for mark in (plan.prefix, plan.suffix, plan.middle)):
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = byte_places(text, [x, y])
    form = "spm" if h4 % 100 < plan.suffix_first else "psm"
    return n, form, x, y - x, bytes(rotate(text, (a, b), form, plan))


def infill(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = PLAN) -> DataFrame:
    """One row per row: doc_id, n, form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FORMS.split(", ")]
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = [transform(i, t, plan) for i, t in zip(piece.column("doc_id").to_pylist(), raw(piece.column("text")), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), as_text(list(output))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, FORMS)


def restore(forms: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The rows of ``infill`` with ``text``: the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "output"):
                texts = [restored(o, f, plan) for o, f in zip(raw(piece.column("output")), piece.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, as_text(texts)], names=[*piece.schema.names, "text"])

    return forms.select(*[f.split()[0] for f in FORMS.split(", ")]).mapInArrow(run, f"{FORMS}, text string")
