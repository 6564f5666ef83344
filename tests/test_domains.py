"""Domain discovery on the documented fixtures."""

from lakescope.operators import domains
from lakescope.operators.catalog import column_rows
from lakescope.plans.registry import TABLES

ECOMMERCE = {
    "customers": "customer_id name email phone city province segment registered_at is_active",
    "order_items": "item_id order_id product_id quantity unit_price discount_rate subtotal",
    "orders": "order_id customer_id order_date ship_date status payment_method shipping_fee total_amount discount_amount",
    "products": "product_id name category sub_category brand unit_price cost_price stock_qty is_active",
}
HR = {
    "departments": "dept_id dept_name parent_dept_id manager_id location budget headcount",
    "employees": "employee_id name dept_id manager_id title level salary bonus_rate hire_date status city",
}
SHOP_A = {"shop_orders": "order_id customer_id order_date total_amount"}
SHOP_B = {"shop_customers": "customer_id customer_name email city"}


def columns_of(spark, *sources):
    rows, pos = [], 0
    for source, tables in sources:
        for t, cols in tables.items():
            rows += [(source, t, pos, i, c, "string", True, None) for i, c in enumerate(cols.split())]
            pos += 1
    from lakescope.operators.catalog import COLUMN_SCHEMA

    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["label"], set()).add(r["table_name"])
    return {frozenset(g) for g in out.values()}


def test_eight_tables(spark):
    cols = columns_of(spark, ("a", SHOP_A), ("b", SHOP_B), ("e", ECOMMERCE), ("h", HR))
    found, members = domains.discover(cols)
    assert groups(members) == {
        frozenset({"shop_orders", "orders"}),
        frozenset({"shop_customers", "customers"}),
        frozenset({"departments", "employees"}),
        frozenset({"order_items", "products"}),
    }
    rows = found.collect()
    assert len(rows) == 4 and all(r["table_count"] == 2 and len(r["domain_id"]) == 16 for r in rows)


def test_few_tables_are_one_domain(spark):
    found, members = domains.discover(columns_of(spark, ("e", ECOMMERCE)))
    assert groups(members) == {frozenset(ECOMMERCE)}
    row = found.first()
    # counts: id 6, customer/order/product/name/... ; ties by first appearance
    assert row["domain_name"] == "_".join(row["keywords"][:3])
    assert len(row["keywords"]) == 5


def test_star_schema(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in sorted(TABLES)}
    _, members = domains.discover(column_rows(spark, "sf", frames))
    assert groups(members) == {
        frozenset({"embeddings"}),
        frozenset({"lineitem"}),
        frozenset({"orders"}),
        frozenset({"pages"}),
        frozenset({"customer", "nation", "region", "supplier"}),
        frozenset({"events", "part"}),
        frozenset({"benchmark", "conversations", "documents", "labels"}),
    }
