"""CSV files cut into records by many tasks, against one sequential read."""

import csv
import io
import random

import pytest

from lakescope.session import conf_set
from lakescope.sources import files, records


def plain_records(text, delimiter=","):
    """Records by one pass: a line is joined to the next while a quote is open."""
    out, held, inside = [], [], False
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        held.append(line)
        inside = records.open_after(line, inside, delimiter)
        if not inside:
            out.append("\n".join(held).removesuffix("\r"))
            held = []
    return out + (["\n".join(held)] if held else [])


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [
        ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a",b', True, False), ('a""b', True, True),
        ('5" pipe,x', False, False), ('x,"a""b"', False, False), ('x,"a"""', False, False), ('x,"a""', False, True), ('",b', True, False), ('","', False, False), ('b","c', True, True),
    ],
)
def test_open_after(line, inside, after):
    assert records.open_after(line, inside, ",") is after


def write(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_text(out.getvalue(), newline="")
    return out.getvalue()


def odd_rows(seed, n=400):
    rng, rows = random.Random(seed), [["id", "text", "amount"]]
    words = ["plain", 'quo"ted', "line\nbreak", 'both "x"\n,y', "é漢", "", "\n\n\n", ",", '"']
    for i in range(n):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))
        rows.append([i, text * (400 if i % 97 == 0 else 1), rng.randrange(100) / 4])
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [200, 4_000])
def test_records_of_many_splits(spark, tmp_path, end, size):
    text = write(tmp_path / "odd.csv", odd_rows(size), end)
    with conf_set(spark, spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="0"):
        found = records.records(spark, str(tmp_path / "odd.csv"), ",")
        rows = found.collect()
        assert spark.read.text(str(tmp_path / "odd.csv")).rdd.getNumPartitions() >= 8
    assert sorted(r["record"] for r in rows) == sorted(plain_records(text))
    assert [r["record"] for r in rows if r["first"]] == ["id,text,amount"]


def test_split_read_equals_one_task(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"part{i}.csv", odd_rows(i, 150))
    one = spark.read.options(header=True, inferSchema=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path))
    want = sorted(map(str, one.collect()))
    with conf_set(spark, spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="0"):
        got = files.read_csv(spark, str(tmp_path), header=True, delimiter=",")
        assert got.schema == one.schema
        assert sorted(map(str, got.collect())) == want


def test_file_that_ends_inside_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,x\n2,"never\nclosed\n')
    (tmp_path / "b.csv").write_text("id,t\n")
    (tmp_path / "c.csv").write_text("")
    got = records.records(spark, str(tmp_path), ",").collect()
    assert sorted((r["record"], r["first"]) for r in got) == [("1,x", False), ('2,"never\nclosed', False), ("id,t", True), ("id,t", True)]


def test_states_over_splits():
    rows = [("f", 0, True, True, True), ("f", 10, False, True, False), ("f", 20, True, False, True), ("f", 30, False, True, False), ("g", 0, False, True, False), ("g", 10, True, True, False)]
    assert records.resolve(rows) == {("f", 0): None, ("f", 10): 0, ("f", 20): 0, ("f", 30): None, ("g", 0): None, ("g", 10): None}
