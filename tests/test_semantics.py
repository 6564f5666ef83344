"""Cases with known outcomes: safety, bounded results, catalogs, join paths, files."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_domains import ECOMMERCE, HR, SHOP_A, SHOP_B, columns_of

from lakescope.functions import text
from lakescope.operators import catalog, joinpaths, search, semantic, sqllog, sqlrun
from lakescope.operators.catalog import column_rows
from lakescope.plans.ingest import workbook_bytes
from lakescope.plans.registry import TABLES
from lakescope.sources import files, jdbc, register, sinks


@pytest.mark.parametrize(
    "sql,reason",
    [
        ("SELECT * FROM orders", None),
        ("WITH s AS (SELECT 1) SELECT * FROM s", None),
        ("-- note\nSELECT 1", None),
        ("SELECT 'drop table x' AS a", None),
        ("SELECT created_at, \"update\" FROM t LIMIT 5", None),
        ("", "Empty SQL statement"),
        ("  \n ", "Empty SQL statement"),
        ("-- only a note", "Empty SQL after removing comments"),
        ("INSERT INTO t VALUES (1)", "Only SELECT statements are allowed. Got: INSERT"),
        ("delete from t", "Only SELECT statements are allowed. Got: DELETE"),
        ("SELECT 1; DROP TABLE t", "Forbidden keyword detected: DROP"),
        ("SELECT replace(a, 'x', 'y') , REPLACE(b) FROM t", "Forbidden keyword detected: REPLACE"),
        ("SELECT 1; SELECT 2", "Multiple statements are not allowed"),
        ("SELECT 1;", None),
    ],
)
def test_safety(spark, sql, reason):
    assert sqllog.check(spark, sql) == {"safe": reason is None, "reason": reason}


WORDS = st.lists(st.sampled_from(["a", "b1", "count(x)", "from t", "where", "1", "+"]), max_size=6).map(" ".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(WORDS, st.sampled_from(sqllog.FORBIDDEN)), min_size=30, max_size=30))
def test_safety_properties(spark, cases):
    """Keywords count outside literals and inside no longer word; comments behind a statement change nothing."""
    expected = []
    for words, keyword in cases:
        expected += [
            (f"SELECT {words}", True),
            (f"SELECT {words} -- {keyword} x", True),
            (f"SELECT {words} /* {keyword} x */", True),
            (f"SELECT '{keyword} x' {words}", True),
            (f"SELECT x{keyword.lower()}y {words}", True),
            (f"SELECT {words} {keyword.lower()} x", False),
            (f"{keyword} {words}", False),
        ]
    rows = sqllog.safety(spark.createDataFrame([(s,) for s, _ in expected], "sql string")).collect()
    verdicts = {r["sql"]: r["safe"] for r in rows}
    assert [(s, verdicts[s]) for s, _ in expected] == expected


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("SELECT TRANSFORM(a) USING 'cat' AS (b) FROM VALUES (1) t(a)", "script transformation"),
        ("SELECT reflect('java.lang.System', 'getenv', 'HOME')", "call of Java code"),
        ("SELECT * FROM (SELECT 1 AS a WHERE try_reflect('java.lang.System', 'exit') IS NULL)", "call of Java code"),
        ("WITH c AS (SELECT java_method('java.lang.System', 'lineSeparator') AS x) SELECT * FROM c", "call of Java code"),
        ("SELECT * FROM parquet.`/etc/passwd`", "direct file relation"),
        ("SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/passwd`)", "direct file relation"),
    ],
)
def test_gate_walks_the_plan(spark, sql, reason):
    with pytest.raises(ValueError, match=reason):
        sqlrun.run_sql(spark, sql)


def test_gate_lets_queries_pass(spark):
    assert sqlrun.run_sql(spark, "SELECT 'reflect(x)' AS a, '--' AS b").first()[0] == "reflect(x)"
    assert sqlrun.run_sql(spark, "WITH c AS (SELECT 1 AS x) SELECT (SELECT max(x) FROM c) AS m FROM c").first()[0] == 1


def test_literals_first(spark):
    sql = "SELECT '--' AS a; DROP TABLE t"
    assert sqllog.check(spark, sql)["safe"]  # the default order hides the rest of the line
    assert not sqllog.check(spark, sql, literals_first=True)["safe"]


def test_run_sql_and_bounds(spark):
    people = spark.createDataFrame([(1, "Alice", 100.5), (2, "Bob, \"B\"", 200.0), (3, None, 300.75)], "id int, name string, amount double")
    people.createOrReplaceTempView("people")
    with pytest.raises(ValueError, match="safety"):
        sqlrun.run_sql(spark, "INSERT INTO people VALUES (4, 'Dan', 1)")
    out = sqlrun.bounded(sqlrun.run_sql(spark, 'SELECT "id", name FROM people ORDER BY id;'), 2)
    assert (out.total, out.truncated, out.rows.count()) == (3, True, 2)
    assert sqlrun.bounded(people, 3).truncated is False
    shown = sinks.markdown_table(out)
    assert shown.splitlines()[0] == "| id | name |" and shown.endswith("_Showing 2 of 3 rows_")
    assert sinks.csv_text(out) == 'id,name\n1,Alice\n2,"Bob, ""B"""'
    doc = sinks.json_document(out).first()["json"]
    assert doc.startswith('{"columns":["id","name"],"rows":[{"id":1') and doc.endswith('"rowCount":3,"truncated":true}')


def test_latest_wins_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "confirmed"), ("b", 1, "inferred")], "k string, n int, status string")
    new = spark.createDataFrame([("a", 2, "x"), ("c", 2, "x")], "k string, n int, status string")
    once = catalog.latest_wins(base, new, ["k"], ["n"], keep=["status"])
    twice = catalog.latest_wins(once, new, ["k"], ["n"], keep=["status"])
    want = {("a", 2, "confirmed"), ("b", 1, "inferred"), ("c", 2, "x")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def found_paths(df):
    return {
        (r["table_a"], r["table_b"], r["signal_source"] if "via" in r["signal_source"] else re.split(r"[. ]", r["join_condition"])[1], round(r["confidence"], 2))
        for r in df.collect()
    }


def test_ecommerce_paths(spark):
    paths = found_paths(joinpaths.discover(columns_of(spark, ("e", ECOMMERCE))))
    assert paths == {
        ("customers", "orders", "customer_id", 0.85),
        ("customers", "products", "name", 0.65),
        ("customers", "products", "is_active", 0.65),
        ("order_items", "orders", "order_id", 0.85),
        ("order_items", "products", "product_id", 0.85),
        ("order_items", "products", "unit_price", 0.65),
        ("customers", "order_items", "indirect:via_orders", 0.68),
        ("customers", "order_items", "indirect:via_products", 0.52),
        ("orders", "products", "indirect:via_customers", 0.52),
        ("orders", "products", "indirect:via_order_items", 0.68),
    }


def test_hr_and_cross_paths(spark):
    assert found_paths(joinpaths.discover(columns_of(spark, ("h", HR)))) == {
        ("departments", "employees", "dept_id", 0.65),
        ("departments", "employees", "manager_id", 0.65),
    }
    cross = joinpaths.discover(columns_of(spark, ("a", SHOP_A), ("b", SHOP_B)), cross=True)
    assert found_paths(cross) == {("shop_orders", "shop_customers", "customer_id", 0.65)}


def test_star_schema_paths(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in sorted(TABLES)}
    cols = column_rows(spark, "sf", frames)
    plain = {(a, b, c) for a, b, c, _ in found_paths(joinpaths.discover(cols))}
    assert plain == {
        ("benchmark", "conversations", "text"), ("benchmark", "documents", "text"),
        ("conversations", "documents", "text"), ("documents", "labels", "doc_id"),
        ("benchmark", "labels", "indirect:via_documents"), ("conversations", "labels", "indirect:via_documents"),
    }
    direct = joinpaths.fuse(joinpaths.candidates(cols, normalise="^[a-z]{1,2}_"))
    pairs = {(r["a_table_name"], r["b_table_name"]) for r in direct.collect()}
    assert {("customer", "orders"), ("lineitem", "orders"), ("nation", "region"), ("region", "supplier")} <= pairs


def test_anchored_paths_equal_full(spark):
    cols = columns_of(spark, ("e", ECOMMERCE), ("h", HR))
    full = joinpaths.discover(cols, cross=True)
    anchors = spark.createDataFrame([("e", "customers"), ("e", "order_items")], "source_id string, table_name string")
    wanted = spark.createDataFrame([("order_items", "customers"), ("customers", "nowhere")], "table_a string, table_b string")
    tables = cols.select("source_id", "table_name").distinct()
    some = joinpaths.lookup(joinpaths.discover(cols, cross=True, anchors=anchors), wanted, tables)
    every = joinpaths.lookup(full, wanted, tables)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    assert some.filter("error is not null").count() == 1 and some.filter("kind = 'indirect'").count() >= 2


def test_lookup_keeps_sources_apart(spark):
    low = {"orders": "id acct_code", "customers": "acct_id"}
    shop = {t: c for t, c in ECOMMERCE.items() if t in ("orders", "customers")}
    cols = columns_of(spark, ("shop", shop), ("old", low))
    tables = cols.select("source_id", "table_name").distinct()
    paths = joinpaths.discover(cols).unionByName(joinpaths.discover(cols, cross=True))
    wanted = spark.createDataFrame([("customers", "orders", None), ("orders", "customers", "old"), ("orders", "customers", "new")], "table_a string, table_b string, source_id string")
    rows = joinpaths.lookup(paths, wanted, tables).collect()
    any_source = {(r["source_id"], r["confidence"], r["warning"] is not None) for r in rows if r["table_a"] == "customers"}
    assert {("shop", 0.85, False), ("old", 0.5, True)} <= any_source
    assert not any(r["source_id"] == "__cross__" and r["join_condition"] == "customers.customer_id = orders.customer_id" for r in rows)
    assert {r["source_id"] for r in rows if r["table_a"] == "orders" and not r["error"]} <= {"old", "__cross__"}
    assert len([r for r in rows if r["error"]]) >= 1


def test_declared_keys_win(spark):
    cols = columns_of(spark, ("e", ECOMMERCE))
    keys = spark.createDataFrame([("e", "orders", "customer_id", "customers.customer_id")], "source_id string, table_name string, column_name string, references string")
    rows = joinpaths.fuse(joinpaths.candidates(cols, foreign_keys=keys)).filter("pa = 'e|customers' and pb = 'e|orders'").collect()
    assert [(r["signal_source"], r["confidence"]) for r in rows] == [("fk_constraint", 1.0)]


def test_type_class(spark):
    names = ["INTEGER", "bigint", "varchar(3)", "array<int>", "decimal(3,1)", "timestamp", "boolean", "INTERVAL", "blob"]
    df = spark.createDataFrame([(n,) for n in names], "d string").select(text.type_class(F.col("d")))
    assert [r[0] for r in df.collect()] == ["INT", "INT", "STRING", "ARRAY<INT>", "NUMERIC", "TEMPORAL", "BOOL", "INT", "BLOB"]


def test_name_tokens(spark):
    df = spark.createDataFrame([("orderItems-Sub Category_a",)], "n string").select(text.name_tokens(F.col("n")))
    assert df.first()[0] == ["order", "items", "sub", "category"]


def test_hybrid_matches_full_ranking(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta"]
    docs = [(i, " ".join(rng.choice(words, 3))) for i in range(600)]
    vecs = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(200, 800)]
    q = [0.3, -1.0, 0.5]
    got = search.hybrid_rrf(
        spark.createDataFrame(docs, "id bigint, text string"), "id", "text", "alpha beta",
        spark.createDataFrame(vecs, "id bigint, v array<double>"), "id", "v", q, 7,
    ).collect()
    kw = sorted([(-sum(w in t for w in ("alpha", "beta")), i) for i, t in docs])
    kw = {i: r for r, (s, i) in enumerate(kw, 1) if s < 0}
    cos = {i: np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q) for i, v in vecs}
    vr = {i: r for r, (_, i) in enumerate(sorted((-round(c, 12), i) for i, c in cos.items()), 1)}
    fused = {i: (1 / (60 + kw[i]) if i in kw else 0) + (1 / (60 + vr[i]) if i in vr else 0) for i in kw | vr}
    want = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[:7]
    assert [r["key"] for r in got] == want


def test_csv_folder_and_collision(spark, tmp_path):
    (tmp_path / "my orders.csv").write_text("id;product;price\n1;Widget;10\n2;Gadget;20\n")
    (tmp_path / "customers.csv").write_text("id,name,since\n1,Alice,2024-01-05\n2,Bob,2024-02-01\n")
    (tmp_path / "skip.txt").write_text("x")
    found = files.read_csv_folder(spark, str(tmp_path))
    assert set(found) == {"my_orders", "customers"}
    assert dict(found["my_orders"].dtypes) == {"id": "int", "product": "string", "price": "int"}
    assert dict(found["customers"].dtypes)["since"] == "date"
    with pytest.raises(ValueError, match="already registered"):
        register.register({"a": {"t": found["customers"]}, "b": {"t": found["my_orders"]}})


def test_csv_header_and_delimiter(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    plain = put("plain.csv", "ann,paris\nbob,rome\n")
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, plain)
    assert files.read_csv(spark, plain, header=False).count() == 2
    assert files.read_csv(spark, plain, header=True).columns == ["ann", "paris"]
    assert files.read_csv(spark, put("typed.csv", "1,paris\n2,rome\n")).count() == 2
    long = put("long.csv", 'id,text\n1,"' + "line\n" * 80 + 'end"\n2,b\n')
    assert [r["text"].count("\n") for r in files.read_csv(spark, long).collect()] == [80, 0]
    with pytest.raises(ValueError, match="delimiter"):
        files.read_csv(spark, put("ragged.csv", "a,b\n1;2;3\n4\n"))


def test_csv_names_collide(spark, tmp_path):
    for name in ("a b.csv", "a_b.csv"):
        (tmp_path / name).write_text("id,n\n1,2\n")
    with pytest.raises(ValueError, match="already read"):
        files.read_csv_folder(spark, str(tmp_path))


def test_csv_sink_reads_back(spark, tmp_path):
    rows = [(1, 'say "x", y', "two\nlines"), (2, None, " spaced "), (3, "a;b", "'")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_registration_in_two_calls(spark):
    one, two = spark.range(1), spark.range(2)
    register.register({"src:one": {"twice": one}})
    register.register({"src:one": {"twice": one}})  # a refresh
    with pytest.raises(ValueError, match="already registered by src:one"):
        register.register({"src:two": {"twice": two}})
    assert spark.table("twice").count() == 1
    register.unregister(spark, "src:one")
    register.register({"src:two": {"twice": two}})
    register.unregister(spark, "src:two")


def test_workbooks(spark, tmp_path):
    head = ["id", "name", None, "empty", "id"]
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"Sheet1": [head, [1, "Alice", "x", None, 5], [2.5, None, "y", None, 6]], "Other": [["x"], [7]]}))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"Sheet1": [["city"], ["Rome"]]}))
    found = files.read_workbooks(spark, str(tmp_path))
    assert sorted(found) == ["a_Other", "a_Sheet1", "b_Sheet1"]
    assert found["a_Sheet1"].columns == ["id", "name", "column_3", "empty", "id_2"]
    assert sorted(tuple(r) for r in found["a_Sheet1"].collect()) == [(1.0, "Alice", "x", None, 5.0), (2.5, None, "y", None, 6.0)]
    assert [tuple(r) for r in found["b_Sheet1"].collect()] == [("Rome",)]


def test_jdbc_settings():
    assert jdbc.url("mysql", "h", "d") == "jdbc:mysql://h:3306/d"
    assert jdbc.url("postgresql", "h", "d", 1) == "jdbc:postgresql://h:1/d"
    assert jdbc.options("u", "me", "pw")["password"] == "pw"
    assert "'o''x'" in jdbc.columns_sql("postgresql", "o'x") and "column_comment" in jdbc.columns_sql("mysql", "d")
    with pytest.raises(ValueError):
        jdbc.url("oracle", "h", "d")


def test_semantic_file(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"tables": [{"tableName": "orders", "description": "all orders", "businessDomain": "shop", "tags": ["core", " "],'
        '"columns": [{"name": "amount", "unit": "CNY", "enumValues": {"a": "open"}}],'
        '"relations": [{"targetTable": "customers", "joinCondition": "orders.cid = customers.id"}],'
        '"metrics": [{"name": "daily gmv", "expression": "SUM(amount)", "groupBy": "DATE(at)", "filter": "amount > 0"}]}]}'
    )
    d = semantic.load(spark, str(tmp_path / "d.json"))
    row = d.first()
    assert row["relations"][0]["relation_type"] == "one_to_many" and row["business_domain"] == "shop"
    assert semantic.build_index(d).first()["searchable_text"] == "orders all orders core shop amount CNY open daily gmv"
    sql = semantic.suggest_metric_sql(d).first()["sql"]
    assert sql == 'SELECT DATE(at), SUM(amount) AS "daily gmv" FROM orders WHERE amount > 0 GROUP BY DATE(at)'


def test_scratch_scope_deletes_its_tables(spark):
    import os

    from lakescope.session import cut_lineage, scratch_scope, shared_dir

    before = shared_dir(spark)
    with scratch_scope(spark) as path:
        assert cut_lineage(spark.range(3)).count() == 3
        assert os.path.isdir(path)
    assert not os.path.exists(path) and shared_dir(spark) == before
