"""Quality classifier: a regularised quadratic discriminant over document statistics.

``FEATURES`` are read from the whole text and transformed to be roughly normal. Per class
the fit needs only count, sum and cross products, which Spark adds up over all labelled
training rows. A class covariance is shrunk towards the pooled one and that towards its
diagonal. Scores are the logistic of the difference of the two log densities (Mahalanobis
distance under cached Cholesky factors, log determinant, log prior).

Defined cases: empty and null texts have the statistics of no words and get a score; rows
without a label, or with contradicting ones, are not learned from; without labels of both
classes every score is the share of class 1 (0.5 without any).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescope.llm.html_text import STOP_WORDS
from lakescope.llm.words import pieces

# Each statistic and what it is in ordinary prose. A text counts as if WORDS
# words of such prose stood beside it, so that a few words prove little.
USUAL = {
    "word_length": 6.0, "word_length_variance": 9.0, "unique_words": 0.7, "repeated_pairs": 0.02, "stop_words": 0.3, "symbols": 0.002, "pipes": 0.0005,
    "digits": 0.003, "capitals": 0.02, "sentence_ends": 0.1, "commas": 0.05, "lines": 0.06, "repeated_lines": 0.02, "letter_runs": 1.0, "compression": 0.45,
    "short_words": 0.35, "top_word": 0.07,
}
FEATURES = tuple(USUAL)
WORDS, BYTES, LINES = 40, 280, 4
POOLED, DIAGONAL = 0.2, 0.1  # shrinkage towards the pooled covariance, and of that towards its diagonal
FLOOR = 1e-3  # least variance
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _odds(name: str, x: float, n: float, beside: float) -> float:
    """Log odds of x out of n, with ``beside`` usual ones added."""
    share = (x + beside * USUAL[name]) / (n + beside)
    return math.log(share / (1 - share)) if share < 1 else 10.0


def _level(name: str, total: float, n: float, beside: float) -> float:
    """Log of the mean total / n, with ``beside`` usual ones added."""
    return math.log((total + beside * USUAL[name]) / (n + beside))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = text.encode()
    low = raw.lower()
    words, size = low.split(), len(raw)
    n = len(words)
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    mean = (int(lengths.sum()) + WORDS * USUAL["word_length"]) / (n + WORDS)
    often = Counter(words)
    pairs = max(n - 1, 0)
    lines = [x for x in low.split(b"\n") if x.strip()]
    runs = low.translate(_LETTERS).split()
    marks = int(c[33:127].sum() - c[48:58].sum() - c[65:91].sum() - c[97:123].sum())
    return [
        math.log(mean),
        _level("word_length_variance", float(((lengths - mean) ** 2).sum()), n, WORDS),
        _odds("unique_words", len(often), n, WORDS),
        _odds("repeated_pairs", pairs - len(set(pairwise(words))), pairs, WORDS),
        _odds("stop_words", sum(map(_STOP.__contains__, runs)), len(runs), WORDS),
        _odds("symbols", marks - int(c[[33, 34, 39, 44, 45, 46, 63, 124]].sum()), size, BYTES),
        _odds("pipes", int(c[124]), size, BYTES),
        _odds("digits", int(c[48:58].sum()), size, BYTES),
        _odds("capitals", int(c[65:91].sum()), size, BYTES),
        _level("sentence_ends", int(c[[33, 46, 63]].sum()), n, WORDS),
        _level("commas", int(c[44]), n, WORDS),
        _level("lines", len(lines), n, WORDS),
        _odds("repeated_lines", len(lines) - len(set(lines)), len(lines), LINES),
        _level("letter_runs", len(runs), n, WORDS),
        _level("compression", len(zlib.compress(raw, 1)) if size else 0, size, BYTES),
        _odds("short_words", int((lengths <= 3).sum()), n, WORDS),
        _odds("top_word", max(often.values(), default=0), n, WORDS),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            x = np.array([statistics(t or "") for t in piece.column("text").to_pylist()], dtype=np.float64)
            columns = [piece.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics ``x`` of each row."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_features, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and the constant terms; or one fixed score."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    fixed: float = 0.5

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        """``moments``: per class the count, the sums and the sums of products."""
        counts = {k: m[0] for k, m in moments.items() if m[0] > 0}
        if len(counts) < 2:
            return cls((), (), (), float(next(iter(counts), 0.5)))
        total = sum(counts.values())
        means = {k: moments[k][1] / counts[k] for k in (0, 1)}
        own = {k: moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)}
        pooled = sum(own[k] * counts[k] for k in (0, 1)) / total
        factors, constants = [], []
        for k in (0, 1):
            cov = (1 - POOLED) * own[k] + POOLED * pooled
            diagonal = np.diag(np.maximum(np.diag(cov), FLOOR))
            cov = (1 - DIAGONAL) * cov + DIAGONAL * diagonal + FLOOR * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(lower))
            constants.append(float(np.log(counts[k] / total) - np.log(np.diag(lower)).sum()))
        return cls((means[0], means[1]), tuple(factors), tuple(constants))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not self.means:
            return np.full(len(x), self.fixed)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and y of the rows to learn from."""
    rows = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")


def fit(stats: DataFrame, labelled: DataFrame) -> Discriminant:
    """Learn from the rows of ``stats`` (see ``features``) that ``training`` names; all of them."""
    d = len(FEATURES)
    products = F.expr("flatten(transform(x, (a, i) -> transform(slice(x, 1, i + 1), b -> a * b)))")
    rows = stats.join(labelled, "doc_id").select("y", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"), products)).alias("i", "v"))
    sums = {(r["y"], r["i"]): r["v"] for r in rows.groupBy("y", "i").agg(F.sum("v").alias("v")).collect()}  # 2 x 190 numbers
    moments, low = {}, np.tril_indices(d)
    for y in (0, 1):
        if (y, 0) in sums:
            square = np.zeros((d, d))
            square[low] = [sums[y, 1 + d + k] for k in range(len(low[0]))]
            moments[y] = (sums[y, 0], np.array([sums[y, 1 + k] for k in range(d)]), square + np.tril(square, -1).T)
    return Discriminant.fit(moments)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Discriminant, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, in one pass over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                x = np.array([statistics(t or "") for t in piece.column(text).to_pylist()], dtype=np.float64)
                yield piece.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
