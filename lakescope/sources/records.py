"""CSV records of files that many tasks read, line breaks inside quotes included.

Whether a line begins a record depends on all lines before it in the file. A split of a
file therefore is looked at twice: first each line is followed under both assumptions (the
split begins a record, or inside quotes), which makes the split a map of two states; the
maps of a file's splits, one row per split, are put together in order, so every split's true
beginning is known; then the lines are cut into records. A record that goes on over the end
of a split is put together from the fragments of its splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

SUMMARY = "path string, start bigint, outside boolean, inside boolean, closes boolean"
PIECES = "path string, owner bigint, start bigint, first boolean, record string"


def open_after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quote is open at the end of a line; a quote opens only at the beginning of a field."""
    at, n = 0, len(line)
    while True:
        if inside:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if at + 1 < n and line[at + 1] == '"':
                    at += 2
                    continue
                break
        elif at < n and line[at] == '"':
            at, inside = at + 1, True
            continue
        inside = False
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += len(delimiter)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The lines of a batch by file and split."""
    path, start, lines = (batch.column(c) for c in ("path", "start", "line"))
    n = batch.num_rows
    if not n:
        return
    change = pc.or_(pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1)))
    cuts = [0, *[i + 1 for i in pc.indices_nonzero(change).to_pylist()], n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield path[a].as_py(), start[a].as_py(), lines.slice(a, b - a)


def _summaries(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, list] = {}
        for batch in batches:
            for path, start, lines in _runs(batch):
                state = done.setdefault((path, start), [False, True, False])
                for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():  # a line without quotes changes nothing
                    state[0] = open_after(line, state[0], delimiter)
                    state[1] = open_after(line, state[1], delimiter)
                    state[2] = state[2] or not state[1]
        rows = [(*k, *v) for k, v in done.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "outside", "inside", "closes"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), *[(c, pa.bool_()) for c in ("outside", "inside", "closes")]]))

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def resolve(summaries: list[tuple]) -> dict[tuple[str, int], int | None]:
    """(file, split) -> None if the split begins a record, else the split in which the open record began."""
    out, before = {}, None
    for path, start, outside, inside, closes in sorted(summaries):
        if before is None or before[0] != path:
            open_, owner = False, None
        else:
            open_, owner = before[1], before[2]
        out[path, start] = owner if open_ else None
        # the record open at the end began here, unless the split lies inside one record
        ends_open = inside if open_ else outside
        before = (path, ends_open, owner if open_ and not closes else start)
    return out


def _cut(delimiter: str, begins):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, owner, held, first = None, None, [], False
        known = begins.value

        def flush(out: list) -> None:
            if held:  # the split ends inside a record
                out.append((here[0], here[1] if owner is None else owner, here[1], first, "\n".join(held)))
                held.clear()

        for batch in batches:
            out: list[tuple] = []
            for path, start, lines in _runs(batch):
                if (path, start) != here:
                    flush(out)
                    here = (path, start)
                    owner, first = known[path, start], start == 0
                quoted = pc.match_substring(lines, '"')
                if not held and owner is None and not pc.any(quoted).as_py():
                    for line in lines.to_pylist():
                        out.append((path, None, start, first, line.removesuffix("\r")))
                        first = False
                    continue
                for line, has in zip(lines.to_pylist(), quoted.to_pylist(), strict=True):
                    inside = bool(held) or owner is not None
                    held.append(line)
                    if open_after(line, inside, delimiter) if has else inside:
                        continue
                    out.append((path, owner, start, first, "\n".join(held).removesuffix("\r")))
                    held.clear()
                    owner, first = None, False
            if out:
                yield _rows(out)
        out = []
        flush(out)
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``record`` and ``first`` (the first of its file) of every CSV record of a file or folder."""
    lines = _lines(spark, path)
    seen = [tuple(r) for r in lines.mapInArrow(_summaries(delimiter), SUMMARY).collect()]  # one row per split
    begins = resolve(seen)
    cut = lines.mapInArrow(_cut(delimiter, spark.sparkContext.broadcast(begins)), PIECES)
    ordered = sorted(begins)
    whole = cut.filter("owner IS NULL").select("record", "first")
    if not any(o is not None for o in begins.values()) and not _open_ends(seen, begins, ordered):
        return whole
    parts = cut.filter("owner IS NOT NULL").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "record", "first"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), F.exists("parts", lambda p: p["first"]).alias("first"))
    return whole.unionByName(joined)


def _open_ends(seen: list[tuple], begins: dict, ordered: list[tuple]) -> bool:
    """Whether some file ends inside quotes."""
    last = {path: (path, start) for path, start in ordered}
    ends = {(p, s): (o, i) for p, s, o, i, _ in seen}
    return any(ends[k][0 if begins[k] is None else 1] for k in last.values())


def parse(reader: DataFrameReader, rows: DataFrame) -> DataFrame:
    """Spark's own CSV parser over a column of records."""
    encoder = rows.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return reader._df(reader._jreader.csv(getattr(rows.select("record")._jdf, "as")(encoder)))
