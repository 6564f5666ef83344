"""Token counts of sections by offsets: a document is encoded once, as a whole.

Byte lengths of the tokens give their character spans; the spans are joined with the
sections' spans, and a token that crosses a boundary is allotted by a stated rule:

* ``start``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the first of equals;
* ``split``: to each section in proportion to its characters.

A character whose bytes are spread over tokens belongs to the token of its first byte; a
token without a first byte has an empty span at the end of that character's predecessor.
Sections are contiguous, so the counts of a document add up to the count of the whole.

Defined cases: null and empty texts have no sections; special strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm.words import pieces

RULES = ("start", "most", "split")
LINES = re.compile(r"[^\n]*\n+|[^\n]+\Z")


def lines(text: str) -> list[tuple[str, int]]:
    """(name, start) of the sections of a text: its lines, each with the breaks behind it."""
    return [(str(i), m.start()) for i, m in enumerate(LINES.finditer(text))]


@lru_cache(maxsize=2)
def encoder(ranks_text: bytes, pattern: str):
    """A tokenizer from the lines of a rank file, and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_ends(text: str, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code point after the last character of each token."""
    ends = np.cumsum(size[ids])
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(raw) == len(text):
        return ends
    begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
    return begun[ends]


def allot(ends: np.ndarray, starts: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those that begin in it cross its end."""
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    after = np.append(starts[1:], n_chars)
    home = np.clip(np.searchsorted(starts, begins, "right") - 1, 0, len(starts) - 1)
    crossing = np.flatnonzero(ends > after[home])
    crossed = np.bincount(home[crossing], minlength=len(starts))
    counts = np.bincount(home, minlength=len(starts)).astype(np.float64)
    if rule != "start":
        for t in crossing.tolist():
            last = int(np.searchsorted(starts, ends[t] - 1, "right")) - 1
            parts = np.array([min(ends[t], after[s]) - max(begins[t], starts[s]) for s in range(home[t], last + 1)], dtype=np.float64)
            counts[home[t]] -= 1
            if rule == "most":
                counts[home[t] + int(parts.argmax())] += 1
            else:
                counts[home[t] : last + 1] += parts / parts.sum()
    return counts, crossed


def _count(ranks_text, pattern: str, rule: str, sections: Callable[[str], list[tuple[str, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = encoder(ranks_text.value, pattern)
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, name, start, end, count, cross = [], [], [], [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    named = sections(text) if text else []
                    if not named:
                        continue
                    starts = np.array([s for _, s in named], dtype=np.int64)
                    ids = np.asarray(encoding.encode_ordinary(text), dtype=np.int64)
                    counts, crossed = allot(token_ends(text, ids, size), starts, len(text), rule)
                    row += [i] * len(named)
                    name += [x for x, _ in named]
                    start += starts.tolist()
                    end += [*starts[1:].tolist(), len(text)]
                    count += counts.tolist()
                    cross += crossed.tolist()
                columns = [piece.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string())]
                columns += [pa.array(x, pa.int64()) for x in (start, end)] + [pa.array(count, pa.float64()), pa.array(cross, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def token_counts(
    docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start", sections: Callable[[str], list[tuple[str, int]]] = lines, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per section: its span in code points, its tokens, and how many cross its end.

    ``sections`` gives the names and starts of a text's sections, the first at 0. The rank
    file is read through Spark, so it may lie in any store, and broadcast: vocabularies are
    of fixed size.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_read(spark, ranks_path))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_count(ranks, pattern, rule, sections), "doc_id bigint, section string, start bigint, end bigint, n_tokens double, n_crossing bigint")


def _read(spark, path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:  # the driver's copy of the vocabulary
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])
