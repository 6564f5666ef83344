"""64-bit hashes of the words of a text column, computed on Arrow buffers in a few vector passes.

A word's hash is a polynomial over a random value per byte, so it does not depend on
where the word stands, and all words of a batch come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes of text worked on at once
CHUNK = 1 << 18  # bytes under one running sum
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_POW = np.full(CHUNK + 1, _BASE, dtype=np.uint64)
_POW[0] = 1
_POW = np.multiply.accumulate(_POW)
_INV = np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
_INV[0] = 1
_INV = np.multiply.accumulate(_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


#: Words of letters, digits and everything beyond ASCII.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Words of everything but ASCII white space.
NONSPACE = ~byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")


def _seeds() -> np.ndarray:
    table = _SEEDS.copy()
    table[0x41:0x5B] = table[0x61:0x7B]  # A-Z count as a-z
    return table


_TABLE = _seeds()


class Words:
    """The words of the rows of a text array: hash, byte range, and which row each belongs to."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        inside = word_bytes[self.raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(inside))]  # a text's end ends its last word
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of row i: bounds[i]:bounds[i + 1]
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        starts, ends, out, i = self.starts, self.ends, np.empty(len(self.starts), dtype=np.uint64), 0
        while i < len(starts):
            base = starts[i]
            j = int(np.searchsorted(ends, base + CHUNK, "right"))
            if j <= i:  # one word longer than a chunk
                total, shift = U(0), U(1)
                with np.errstate(over="ignore"):
                    for at in range(base, ends[i], CHUNK):
                        part = _TABLE[self.raw[at : min(at + CHUNK, ends[i])]]
                        total = total + shift * (part * _POW[: len(part)]).sum(dtype=np.uint64)
                        shift = shift * _POW[CHUNK]
                out[i] = total
                i += 1
                continue
            span = _TABLE[self.raw[base : ends[j - 1]]]
            sums = np.zeros(len(span) + 1, dtype=np.uint64)
            np.cumsum(span * _POW[: len(span)], out=sums[1:])
            a = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[a]) * _INV[a]
            i = j
        return mix(out)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def text(self, i: int, j: int) -> str:
        """Words i to j, A-Z lower-cased, with one space between."""
        return b" ".join(self.raw[self.starts[k] : self.ends[k]].tobytes() for k in range(i, j)).lower().decode("utf-8", "replace")


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; shorter inputs give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * _MULT + hashes[i : i + n]
    return mix(out + U(k))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece stay near ``limit`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
        yield batch.slice(int(part[0]), len(part))
