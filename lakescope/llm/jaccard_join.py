"""Exact similarity join of documents on word shingles in the Jaccard metric.

Two documents link when ``den * |x & y| >= num * |x | y|`` of their sets of distinct
``k``-word shingles, by default with the values of the op3 query; the result is the
components of the links.

1. Documents with equal sets form one class; only one of a class is joined further.
2. Unrelated sets are at distance 1 from everything, so distances to pivots cannot split a
   whole corpus. What can be closer than ``1 - num / den`` to a set shares one of its rarest shingles
   (its prefix). Each shingle that several prefixes hold is a region. Its pivot is the document
   with the fewest rarer shingles (an original rather than an edited copy), and a document is
   copied to all regions its prefix reaches. Prefixes are dealt out by shingle once, many
   entries in a row; what only one document holds ends there.
3. The distance of each document to the pivots of its regions gives the first links. It is
   computed exactly where sizes and the places of the shared shingle in both orders leave a
   link possible with that shingle as the first common one, and where the outlines of both sets
   (counts of hashes in ranges) allow an intersection large enough; elsewhere sizes or outlines
   bound it from below. Copies of one text thus link through one pivot, without pairs among themselves.
   Only texts of documents to be compared are shuffled, told apart by a bit table of fixed size.
4. Regions whose documents are not yet in one component are joined again, once, with what
   lies outside their largest component (no recursion): two documents of different components are
   compared if sizes, places and the triangle inequality over the pivot (their distances to
   it differ by at most ``1 - num / den``) leave a link possible.

The order of shingles by rarity comes from a table of counts of fixed size; any order
gives the same result. Sets are compared as 64-bit hashes of shingles.

Defined cases: null and empty texts have empty sets and are linked with nothing; when ids
repeat or are null, rows are told apart by id and text together, and rows that agree in
both are one document with several rows; every row gets a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.llm import bitset
from lakescope.llm.graph import components
from lakescope.llm.words import NONSPACE, Words, grams, pieces
from lakescope.session import cut_lineage


class Rule(NamedTuple):
    """Words of a shingle, and the least Jaccard similarity of a link as a fraction."""

    k: int = 4
    num: int = 85
    den: int = 100


RULE = Rule()
NEAR = Rule(5, 80, 100)  # near copies where no contract names other values
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
CHUNK_SHINGLES = 1_000_000  # of one pivot's documents, compared by one task
BUCKET_ENTRIES = 1 << 17  # of prefixes, searched at once for shingles that several hold
FLUSH_ENTRIES = 1 << 19  # of prefixes, held by a task before it deals them out
HOT = 1 << 20  # shingles that may occur more often are dealt out row by row, in joins that Spark may split
REACHED = ["shingle", "pivot", "m", "place", "id", "n", "at", "many"]
U = np.uint64


def shingle_sets(texts: pa.Array, k: int = RULE.k) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    yield from sets_of(Words(texts, NONSPACE), k)


def sets_of(words: Words, k: int) -> Iterator[np.ndarray]:
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
        s = np.sort(grams(words.hashes[a:b], min(k, b - a) or 1))
        yield s[np.flatnonzero(np.diff(s, prepend=~s[:1]))] if len(s) > 1 else s


def identity(docs: DataFrame, doc_id: str, text: str) -> Column:
    """The id where ids are unique, else a hash of id and text."""
    seen = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(doc_id).alias("ids")).first()
    return F.col(doc_id).cast("bigint") if seen["rows"] == seen["ids"] else F.xxhash64(doc_id, text)


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their upper zeros compress."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel().astype(np.int64)


def _summaries(k: int):
    """Words, size and digest of each set beside its row, then this task's counts of shingles in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["row", "n_words", "n", "same", "block", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column("row").type
            for piece in pieces(batch, "text"):
                size, same, words = [], [], Words(piece.column("text"), NONSPACE)
                for s in sets_of(words, k):
                    size.append(len(s))
                    same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    np.add.at(counts, (s >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
                none = pa.nulls(piece.num_rows)
                columns = [piece.column("row"), pa.array(words.counts, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if kind is None:
            return
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(used))
        columns = [pa.nulls(len(used), kind), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([_planes(blocks[i]) for i in used], pa.binary())], names=names)

    return run


def _counts(total: np.ndarray) -> bytes:
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()


def _sketch(summaries: DataFrame) -> np.ndarray:
    """Counts of all tasks added up: a table of 2**SKETCH_BITS numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(SKETCH_BLOCK, dtype=np.int64)
        out = []
        for batch in batches:  # sorted by block
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                if b != block:
                    if block is not None:
                        out.append((block, _counts(total)))
                    block, total = b, np.zeros(SKETCH_BLOCK, dtype=np.int64)
                total = total + _from_planes(c, np.int64)
        if block is not None:
            out.append((block, _counts(total)))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], names=["block", "counts"])

    rows = summaries.filter("block IS NOT NULL").select("block", "counts").repartition("block").sortWithinPartitions("block")
    table = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), dtype=np.uint32)
    for r in rows.mapInArrow(add, "block int, counts binary").collect():
        table[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return table.ravel()


def prefix_length(n: int, rule: Rule = RULE) -> int:
    """How many of its rarest shingles a set of n is found by."""
    return n - -(-rule.num * n // rule.den) + 1


def _prefixes(texts: pa.Array, counts: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set and its rarest shingles, rarest first; none where no other set can link."""
    for s in shingle_sets(texts, rule.k):
        p = prefix_length(len(s), rule)
        if p < 2 and len(s) * rule.den // rule.num <= len(s):  # larger sets included
            yield s, s[:0]
            continue
        key = (counts[s >> U(64 - SKETCH_BITS)].astype(np.uint64) << U(64 - 32)) | ((s << U(SKETCH_BITS)) >> U(32))
        rare = np.flatnonzero(key <= np.partition(key, p - 1)[p - 1])
        yield s, s[rare[np.argsort(key[rare], kind="stable")[:p]]]


def _packed(table, rule: Rule, buckets: int, hot: int | None, flush: int):
    """The prefixes' entries, dealt by shingle to buckets: many entries in a row, as arrays.

    Entries of shingles that may occur more than ``hot`` times are left to ``_plain``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = table.value, [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = _prefixes(piece.column("text"), counts, rule)
                for i, shared, (s, prefix) in zip(piece.column("id").to_pylist(), piece.column("marked").to_pylist(), found, strict=True):
                    at = np.arange(len(prefix), dtype=np.uint32)
                    if hot is not None:
                        at = at[counts[prefix >> U(64 - SKETCH_BITS)] <= hot]
                    if len(at):
                        same = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), signed=True) if shared else 0
                        held.append((prefix[at], at, i, same, len(s)))
                        waiting += len(at)
                if waiting > flush:
                    yield _dealt(held, buckets)
                    held, waiting = [], 0
        if held:
            yield _dealt(held, buckets)

    return run


def _dealt(held: list[tuple], buckets: int) -> pa.RecordBatch:
    shingle, at = (np.concatenate([h[c] for h in held]) for c in (0, 1))
    times = [len(h[0]) for h in held]
    ids, same, n = (np.repeat(np.array([h[c] for h in held], dtype=kind), times) for c, kind in ((2, np.int64), (3, np.int64), (4, np.uint32)))
    bucket = (shingle % U(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    parts = np.split(order, first[1:])
    columns = [[c[p].tobytes() for p in parts] for c in (shingle, same)] + [[_planes(c[p]) for p in parts] for c in (ids, n, at)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "shingle", "same", "id", "n", "at"])


def _plain(table, rule: Rule, hot: int):
    """The entries of shingles that may be very frequent, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, found = piece.column("id").to_pylist(), []
                for i, (s, prefix) in zip(ids, _prefixes(piece.column("text"), counts, rule), strict=True):
                    at = np.flatnonzero(counts[prefix >> U(64 - SKETCH_BITS)] > hot)
                    found += [(x, i, len(s), a) for x, a in zip(prefix[at].view(np.int64).tolist(), at.tolist(), strict=True)]
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "id", "n", "at"])

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket holds all entries of its shingles."""
    bucket, held = None, []
    for batch in batches:
        arrays = [batch.column(c) for c in ("shingle", "same", "id", "n", "at")]
        for i, b in enumerate(batch.column("bucket").to_pylist()):
            if b != bucket and held:
                yield from _regions_of(held)
                held = []
            bucket = b
            held.append((*[np.frombuffer(c[i].as_buffer(), dtype=np.int64) for c in arrays[:2]], *[_from_planes(c[i], kind) for c, kind in zip(arrays[2:], (np.int64, np.uint32, np.uint32), strict=True)]))
    if held:
        yield from _regions_of(held)


def _regions_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    shingle, same, ids, n, at = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(shingle, kind="stable")
    again = np.diff(shingle[order]) == 0
    order = order[np.append(again, False) | np.append(False, again)]  # shingles of one entry end here
    shingle, ids, same, n, at = (c[order] for c in (shingle, ids, same, n, at))
    order = np.lexsort((ids, same, n, at, shingle))
    known = np.stack([c[order] for c in (shingle, at, n, same)])
    first = np.append(True, (known[:, 1:] != known[:, :-1]).any(axis=0))[: len(order)]
    order = order[first | (known[3] == 0)]  # of equal sets the smallest id; sets that no other equals have 0
    order = order[np.lexsort((ids[order], at[order], shingle[order]))]
    shingle, ids, n, at = (c[order] for c in (shingle, ids, n, at))
    _, first, many = np.unique(shingle, return_index=True, return_counts=True)
    rest = np.ones(len(shingle), dtype=bool)
    rest[first] = False
    pivot = np.repeat(first, many)[rest]
    columns = (shingle[rest], ids[pivot], n[pivot], at[pivot], ids[rest], n[rest], at[rest], np.repeat(many, many)[rest])
    rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=REACHED)
    yield from (rows.slice(i, 1 << 16) for i in range(0, rows.num_rows, 1 << 16))


def _reached(rows: DataFrame, of: DataFrame, shared: DataFrame, table, rule: Rule, entries: int) -> DataFrame:
    """One row per shingle that several prefixes hold and document beside the pivot, with sizes and places.

    ``rows``: id and text; ``of``: id, class and n; ``shared``: ids whose sets others equal; ``entries``: about how many all prefixes have.
    """
    kinds = ", ".join(f"{c} bigint" for c in REACHED)
    buckets, hot = max(1, -(-entries // BUCKET_ENTRIES)), HOT if table.value.max() > HOT else None
    packed = bitset.marked(rows, "id", shared, "id").mapInArrow(_packed(table, rule, buckets, hot, FLUSH_ENTRIES), "bucket bigint, shingle binary, same binary, id binary, n binary, at binary")
    parts = min(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    out = dealt.mapInArrow(_regions, kinds)
    if hot is None:
        return cut_lineage(out)
    plain = rows.mapInArrow(_plain(table, rule, hot), "shingle bigint, id bigint, n bigint, at bigint").join(of.filter("id = class").select("id"), "id", "left_semi")
    plain = cut_lineage(plain.distinct())
    cells = plain.groupBy("shingle").agg(F.min(F.struct("at", "id", "n")).alias("p"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    # written, so that the join below may split a shingle that very many documents hold
    cells = cut_lineage(cells.select("shingle", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"), F.col("p.at").alias("place"), "many"))
    return cut_lineage(out.unionByName(plain.join(cells, "shingle").filter("id <> pivot").select(*REACHED)))


def outline(s: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of about as many equal ranges: half a byte each, 15 for 15 or more."""
    bits = max(6, len(s).bit_length() - 1)
    cells = np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (cells[::2] | cells[1::2] << 4).tobytes()


def most_common(a: bytes, b: bytes) -> int | None:
    """An upper bound of the elements that sets of these outlines share; none where a cell is full."""
    cells = []
    for x in (a, b):
        x = np.frombuffer(x, dtype=np.uint8)
        cells.append(np.stack([x & 15, x >> 4], axis=1).ravel().astype(np.int64))
        if cells[-1].max() == 15:
            return None
    x, y = sorted(cells, key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def _outlines(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = list(shingle_sets(piece.column("text"), k))
                columns = [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([outline(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "cells"])

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = (batch.column(c).to_pylist() for c in ("n", "m"))
        known = [most_common(a.as_py(), b.as_py()) for a, b in zip(batch.column("cells"), batch.column("pivot_cells"), strict=True)]
        most = [min(x, y) if z is None else z for x, y, z in zip(n, m, known, strict=True)]
        least = [x + y - z for x, y, z in zip(n, m, most, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pivot", "id", "n")), pa.array(most, pa.int64()), pa.array(least, pa.int64())], names=["pivot", "id", "n", "most", "least"])


def _bounds(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The size n of the set of id, and the largest intersection and smallest union that the outlines of each (pivot, id) pair leave possible.

    Outlines take a fraction of the texts, so texts are only shuffled for pairs that these bounds leave open.
    """
    asked = pairs.select("id").unionByName(pairs.select(F.col("pivot").alias("id")))
    outlines = bitset.marked(rows, "id", asked, "id").filter("marked").select("id", "text").mapInArrow(_outlines(k), "id bigint, n bigint, cells binary")
    outlines = cut_lineage(outlines.dropDuplicates(["id"]))
    pivots = outlines.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("cells").alias("pivot_cells"))
    both = pairs.join(outlines, "id").join(pivots, "pivot").select("pivot", "id", "n", "m", "cells", "pivot_cells")
    return cut_lineage(both.mapInArrow(_bounded, "pivot bigint, id bigint, n bigint, most bigint, least bigint"))


def _compare(k: int):
    """Rows come sorted by pivot, chunk, member; the pivot's own text (member 0) leads each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                columns = [piece.column(c).to_pylist() for c in ("pivot", "member", "id")]
                out = []
                for p, member, i, s in zip(*columns, shingle_sets(piece.column("text"), k), strict=True):
                    if not member:
                        held = s
                        continue
                    at = np.minimum(np.searchsorted(held, s), max(len(held) - 1, 0))
                    both = int((held[at] == s).sum()) if len(held) else 0
                    out.append((p, i, both, len(held) + len(s) - both))
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pivot", "id", "both", "either"])

    return run


def _verify(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Exact intersection and union of each (pivot, id) pair; ``rows`` holds id and text, ``pairs`` also the size n of the set of id."""
    load = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("chunks"))
    dealt = pairs.join(load, "pivot").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    members = dealt.select("id", F.struct("pivot", "chunk", F.lit(1).alias("member")).alias("ask"))
    own = load.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(F.col("pivot").alias("id"), F.struct("pivot", "chunk", F.lit(0).alias("member")).alias("ask"))
    asked = cut_lineage(members.unionByName(own).groupBy("id").agg(F.collect_list("ask").alias("asked")))
    found = bitset.marked(rows, "id", asked, "id").filter("marked").join(asked, "id")
    texts = found.select("id", "text", F.explode("asked").alias("ask")).select("ask.*", "id", "text")  # a text takes less than its hashes
    together = texts.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "member")
    return cut_lineage(together.mapInArrow(_compare(k), "pivot bigint, id bigint, both bigint, either bigint"))


def _meet(n: Column, at: Column, m: Column, place: Column, rule: Rule) -> Column:
    """Whether sets of n and m elements can link and have their first common element at these places.

    Places count from 0 in the common order. The sets must share ``need`` elements; before
    the first common one there is room for what the rest cannot hold.
    """
    need = F.ceil(rule.num * (n + m) / F.lit(rule.num + rule.den) - 1e-6)
    room = F.least(at, place) + 1 + F.least(n - at - 1, m - place - 1)
    return (F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num) & (at <= n - need) & (place <= m - need) & (room >= need)


def _across(regions: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of documents of a region and of different components that may link.

    ``regions``: shingle, id, n, at, component, outside (of the region's largest component), low, high (bounds of the
    distance to the pivot). Documents of a region's largest component are only compared with those outside it.
    """
    rows = regions.withColumn("band", F.floor(F.log("n") / (math.log(rule.den / rule.num) + 1e-9)))
    left = rows.filter("outside").select("shingle", F.explode(F.array(*[F.col("band") + x for x in (-1, 0, 1)])).alias("band"), *[F.col(c).alias(f"l_{c}") for c in ("id", "n", "at", "component", "low", "high")])
    slack = 1 - rule.num / rule.den + 1e-9
    pairs = left.join(rows, ["shingle", "band"]).filter(
        (F.col("l_component") != F.col("component"))
        & (~F.col("outside") | (F.col("l_id") < F.col("id")))
        & (F.col("l_low") <= F.col("high") + slack)
        & (F.col("low") <= F.col("l_high") + slack)
        & _meet(F.col("l_n"), F.col("l_at"), F.col("n"), F.col("at"), rule)
    )
    return pairs.select(F.least("l_id", "id").alias("pivot"), F.greatest("l_id", "id").alias("id")).distinct()


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = RULE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id, doc_id, n_shingles, n_words, ``first`` (smallest id of its component), component_id (smallest doc_id), and the columns to ``keep``."""
    spark = docs.sparkSession
    row = F.struct(identity(docs, doc_id, text).alias("id"), F.col(doc_id).cast("bigint").alias("doc_id"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = rows.select("row", "text", "row.id")
    summaries = cut_lineage(rows.select("row", "text").mapInArrow(_summaries(rule.k), f"row {kind}, n_words bigint, n bigint, same binary, block int, counts binary"))
    known = summaries.filter("block IS NULL").select("row.*", "n_words", "n", "same")
    table = spark.sparkContext.broadcast(_sketch(summaries))

    classes = known.filter("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("same", "class")
    placed = known.join(classes, "same", "left").withColumn("shared", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", "id"))
    placed = cut_lineage(placed.drop("same"))
    of = placed.filter("n > 0").select("id", "class", "n").distinct()

    entries = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (rule.den - rule.num) // rule.den
    shared = placed.filter("shared").select("id")
    reached = _reached(rows.select("id", "text"), of, shared, table, rule, entries)
    near = reached.filter(_meet(F.col("n"), F.col("at"), F.col("m"), F.col("place"), rule)).select("pivot", "id").distinct()
    bounds = _bounds(rows.select("id", "text"), cut_lineage(near), rule.k)
    is_open, is_link = (F.col(x) * rule.den >= F.col(y) * rule.num for x, y in (("most", "least"), ("both", "either")))
    measured = _verify(rows.select("id", "text"), bounds.filter(is_open).select("pivot", "id", "n"), rule.k)
    links = measured.filter(is_link).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    found = components(links)

    further = cut_lineage(_across(cut_lineage(_open_regions(reached, bounds, measured, found)), rule).join(bounds.select("pivot", "id"), ["pivot", "id"], "left_anti"))
    further = _bounds(rows.select("id", "text"), further, rule.k).filter(is_open).select("pivot", "id", "n")
    if not further.isEmpty():
        more = _verify(rows.select("id", "text"), further, rule.k).filter(is_link).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        found = components(links.unionByName(more))

    known_as = placed.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("first", F.coalesce("component", "class"))
    least = known_as.filter("n > 0 AND (shared OR component IS NOT NULL)").groupBy("first").agg(F.min("doc_id").alias("component_id"))
    out = known_as.join(least, "first", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("id", "doc_id", F.col("n").alias("n_shingles"), "n_words", "first", component.alias("component_id"), *[F.col(f"kept_{c}").alias(c) for c in keep])


def _open_regions(reached: DataFrame, bounds: DataFrame, measured: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of regions that hold more than one component, with bounds of their distance to the pivot."""
    inside = reached.filter("many > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = inside.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    exact = bounds.join(measured, ["pivot", "id"], "left").select("pivot", "id", (1 - F.col("most") / F.col("least")).alias("d_least"), (1 - F.col("both") / F.col("either")).alias("d"))
    low = F.coalesce("d", "d_least", 1 - F.least("m", "n") / F.greatest("m", "n"))
    bounded = inside.join(largest, "shingle").join(exact, ["pivot", "id"], "left")
    return bounded.select("shingle", "id", "n", "at", "component", (F.col("component") != F.col("largest")).alias("outside"), low.alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, and all without links."""
    found = cut_lineage(similar_documents(docs, doc_id, text, rule).select("id", "first", "n_shingles"))
    # only rows that may go or repeat are dealt out with their texts
    special = found.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("first").alias("first")).filter("copies > 1 OR id <> first")
    keep = found.filter("id = first").select("id", "n_shingles").distinct()
    rows = bitset.marked(docs.select(F.struct("*").alias("row"), identity(docs, doc_id, text).alias("at")), "at", special, "id")
    one = F.row_number().over(Window.partitionBy("at").orderBy(F.lit(1)))
    kept = rows.filter("marked").join(keep, F.col("at") == F.col("id")).withColumn("copy", one).filter("copy = 1 OR n_shingles = 0")
    return rows.filter("NOT marked").select("row").union(kept.select("row")).select("row.*")
