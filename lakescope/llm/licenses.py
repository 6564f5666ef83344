"""License texts in documents.

Words are runs of ASCII letters and digits and all characters beyond ASCII, A-Z
lower-cased. Templates are fingerprinted by winnowing: of every ``window`` k-grams in a row
the smallest hash is kept. The fingerprints form an inverted index of (template, place); it
is as large as the templates, which are fixed. A document is winnowed alike, and a shared
fingerprint names the shifts at which the template may lie. Matched words of a reportable
region are cut into runs by at most the unmatched words, by as many insertions and by those
that the band allows, so one run has ``shared_run`` words or more; ``k + window - 1`` is not
longer, hence no reportable region is without a hit.

A banded alignment at a shift can only match words of one stretch of the document, and only
at diagonals within ``BAND`` of the shift. So a hit shift is aligned if the stretch holds as
many words of the template as ``COVERAGE`` asks for and as many places of the template are
hit at those diagonals. Both are upper bounds of the matched words. The alignment then finds
the matched words, and regions covering at least ``COVERAGE`` of the template are reported.

Defined cases: null or empty texts match nothing; every match of a template is reported,
also when it repeats; rows that repeat are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.llm.words import ALNUM, Words, pieces

# Notices by which texts are licensed.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.",
}

BAND = 4  # words that an alignment may shift
COVERAGE = 0.8
SHIFTS = 4_096  # looked at together
LONGEST = 5  # words of a k-gram at most
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier


def shared_run(n: int, needed: int) -> int:
    """Words in a row that any ``needed`` matches of ``n`` words within the band have at least."""
    return -(-needed // (2 * (n - needed) + 2 * BAND + 1))


def winnow(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest k-gram of every ``window`` in a row, the last one on ties."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = h[:n].copy()
    for i in range(1, k):
        grams = (grams ^ (grams >> np.uint64(29))) * MIX + h[i : i + n]
    if window == 1:
        return np.arange(n), grams
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1))
    return at, grams[at]


def _template_words(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), ALNUM)
    return [words.hashes[words.bounds[i] : words.bounds[i + 1]] for i in range(len(texts))]


class TemplateIndex:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words = _template_words(list(templates.values()))
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(1, dtype=np.uint64)]))
        self.holds = np.zeros((len(self.names), len(self.vocabulary) + 1), dtype=bool)
        self.needed = [max(1, math.ceil(COVERAGE * len(h))) for h in self.words]
        postings: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, h in enumerate(self.words):
            self.holds[t, np.searchsorted(self.vocabulary, h)] = True
            if len(h):
                run = shared_run(len(h), self.needed[t])
                k = min(run, LONGEST)
                places, prints = winnow(h, k, run - k + 1)
                postings.setdefault((k, run - k + 1), []).extend(zip(prints.tolist(), [t] * len(places), places.tolist(), strict=True))
        self.postings = {}  # (k, window): distinct fingerprints, first posting of each, templates, places
        for key, rows in postings.items():
            rows.sort()
            prints = np.array([r[0] for r in rows], dtype=np.uint64)
            distinct, first = np.unique(prints, return_index=True)
            self.postings[key] = distinct, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def hits(self, h: np.ndarray, able: np.ndarray) -> dict[int, np.ndarray]:
        """Per ``able`` template the shifts (place in the document less place in the template) of shared fingerprints."""
        out: dict[int, np.ndarray] = {}
        for (k, window), (distinct, first, template, place) in self.postings.items():
            if not able[template].any():
                continue
            at, prints = winnow(h, k, window)
            if not len(at):
                continue
            entry = np.minimum(np.searchsorted(distinct, prints), len(distinct) - 1)
            shared = distinct[entry] == prints
            at, entry = at[shared], entry[shared]
            held = first[entry + 1] - first[entry]
            posting = np.repeat(first[entry] - np.cumsum(held) + held, held) + np.arange(held.sum())
            shift, t = np.repeat(at, held) - place[posting], template[posting]
            for x in np.flatnonzero(able & (np.bincount(t, minlength=len(able)) > 0)).tolist():
                out[x] = shift[t == x]
        return out

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(template, shift) of all banded alignments that share a fingerprint and can match enough words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == h, at, len(self.vocabulary))
        if np.count_nonzero(code < len(self.vocabulary)) < min(self.needed, default=1):
            return []
        able = self.holds @ np.bincount(code, minlength=len(self.vocabulary) + 1) >= self.needed
        if not able.any():
            return []
        out = []
        for t, shift in sorted(self.hits(h, able).items()):
            n = len(self.words[t])
            held = np.zeros(len(h) + 1, dtype=np.int32)
            np.cumsum(self.holds[t][code], out=held[1:])
            near = np.zeros(len(h) + n + 2 * BAND, dtype=bool)  # shifts from 1 - n - BAND on
            for drift in range(2 * BAND + 1):
                near[shift + n - 1 + drift] = True
            shifts = np.flatnonzero(near) + 1 - n - BAND
            stretch = held[np.clip(shifts + n + BAND, 0, len(h))] - held[np.clip(shifts - BAND, 0, len(h))]
            likely = shifts[stretch >= self.needed[t]]
            for run in np.split(likely, np.flatnonzero(np.diff(likely) > 1) + 1) if len(likely) else ():
                for start in range(0, len(run), SHIFTS):
                    part = run[start : start + SHIFTS]
                    out += [(t, s) for s in part[self._places_hit(t, h, int(part[0]), int(part[-1])) >= self.needed[t]].tolist()]
        return out

    def _places_hit(self, t: int, h: np.ndarray, first: int, last: int) -> np.ndarray:
        """For each shift, how many places of the template have an equal word within ``BAND`` of it."""
        template = self.words[t]
        place = np.arange(len(template))[:, None] + np.arange(first - BAND, last + BAND + 1)
        equal = (h[np.clip(place, 0, len(h) - 1)] == template[:, None]) & (place >= 0) & (place < len(h))
        upto = np.zeros((len(template), place.shape[1] + 1), dtype=np.int32)
        np.cumsum(equal, axis=1, out=upto[:, 1:])
        return (upto[:, 2 * BAND + 1 :] > upto[:, : -2 * BAND - 1]).sum(axis=0)


def align(template: np.ndarray, region: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Most matching words of template and region in order, as index pairs.

    Only places (i, j) with ``|j - i - shift| <= band`` are looked at.
    """
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 2), dtype=np.int32)  # best[i, w]: first i words against region up to i + shift + w - band - 1
    equal = np.zeros((n, width), dtype=bool)
    for i in range(n):
        j = np.arange(width) + i + shift - band
        ok = (j >= 0) & (j < len(region))
        equal[i, ok] = region[j[ok]] == template[i]
        row = np.maximum(best[i, 1 : width + 1] + equal[i], best[i, 2 : width + 2])
        best[i + 1, 1 : width + 1] = np.maximum.accumulate(row)
        best[i + 1, width + 1] = best[i + 1, width]
    out, i, w = [], n, width - 1
    while i > 0 and w >= 0:
        value = best[i, w + 1]
        if w > 0 and best[i, w] == value:
            w -= 1
        elif equal[i - 1, w] and best[i - 1, w + 1] + 1 == value:
            out.append((i - 1, i - 1 + shift + w - band))
            i -= 1
        elif best[i - 1, w + 2] == value:
            i, w = i - 1, w + 1
        else:
            i -= 1
        w = min(w, width - 1)
    return out[::-1]


def matches(h: np.ndarray, index: TemplateIndex) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, word after the last) of each reported region."""
    out = set()
    for t, shift in index.candidates(h):
        pairs = align(index.words[t], h, shift, BAND)
        if pairs and len(pairs) >= COVERAGE * len(index.words[t]):
            out.add((t, len(pairs), pairs[0][1], pairs[-1][1] + 1))
    best: list[tuple[int, int, int, int]] = []
    for m in sorted(out, key=lambda m: (m[0], -m[1], m[3] - m[2], m[2])):  # the better of overlapping regions
        if not any(b[0] == m[0] and b[2] < m[3] and m[2] < b[3] for b in best):
            best.append(m)
    return sorted(best, key=lambda m: (m[2], m[0]))


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, rows = Words(piece.column("text"), ALNUM), []
                texts = piece.column("text")
                for i in range(piece.num_rows):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    found = matches(words.hashes[a:b], index)
                    if found:
                        raw = (texts[i].as_py() or "").encode()
                        base = int(words.offsets[i])
                    for t, n, first, after in found:
                        start = len(raw[: int(words.starts[a + first]) - base].decode("utf-8", "replace"))
                        end = start + len(raw[int(words.starts[a + first]) - base : int(words.ends[a + after - 1]) - base].decode("utf-8", "replace"))
                        rows.append((i, index.names[t], n, len(index.words[t]), start, end))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], pa.string()),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.int32()),
                        pa.array(columns[5], pa.int32()),
                    ],
                    names=["doc_id", "license", "n_matched", "n_template", "start", "end"],
                )

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched region: doc_id, license, matched words, words of the template, coverage, code points."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(_scan(templates), "doc_id bigint, license string, n_matched int, n_template int, start int, end int")
    return found.withColumn("coverage", F.round(F.col("n_matched") / F.col("n_template"), 4))
