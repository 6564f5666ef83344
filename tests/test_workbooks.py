"""Tables of many workbooks."""

from lakescope.plans.ingest import workbook_bytes
from lakescope.sources import files


def test_jobs_do_not_grow_with_the_workbooks(spark):
    """The columns of all sheets are found together, so more workbooks are no more jobs."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 8):
        books = [(f"b{i}.xlsx", bytearray(workbook_bytes({"one": [["a", None], [i, "x"]], "two": [["a", "a"]]}))) for i in range(n)]
        spark.sparkContext.setJobGroup(f"books{n}", "")
        tables = files.workbook_tables(files.workbook_cells(spark.createDataFrame(books, "path string, content binary")))
        jobs.append(len(tracker.getJobIdsForGroup(f"books{n}")))
        assert list(tables) == [f"b{i}_{s}" for i in range(n) for s in ("one", "two")]
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] <= jobs[0] + 1
    assert [tuple(r) for r in tables["b7_one"].collect()] == [(7.0, "x")]
    assert tables["b7_one"].columns == ["a", "column_2"] and tables["b7_two"].columns == ["a", "a_2"]
