"""Catalogs derived from the tables, so that catalog jobs grow with the data.

``order_lake``: every customer is a source, every order a table of it, and the
line items of the order give its columns; orders refer to the customer's first order,
those of low priority to the last one. ``entity_lake``: three sources whose
tables are the single customers, orders and suppliers, with key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.plans.registry import table
from lakescope.session import cut_lineage


def _col(ordinal, name, dtype, comment=None):
    return F.struct(
        F.lit(ordinal).cast("bigint").alias("ordinal"),
        name.alias("column_name"),
        F.lit(dtype).alias("dtype"),
        (F.lit(None).cast("string") if comment is None else comment).alias("comment"),
    )


def _firsts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def order_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    keyed = orders.join(_firsts(orders), "o_custkey")
    first = F.concat(F.lit("order"), F.col("first_key").cast("string"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("FK -> "), first, F.lit("s.id")))
    key = F.when(F.col("o_orderpriority") == "5-LOW", F.col("last_key")).otherwise(F.col("first_key"))
    parent = F.concat(F.lit("order"), key.cast("string"), F.lit("_id"))
    own = keyed.select(
        "o_orderkey",
        F.inline(
            F.filter(
                F.array(
                    _col(0, F.lit("id"), "bigint"),
                    F.when(key != F.col("o_orderkey"), _col(1, parent, "bigint", urgent)),
                ),
                lambda c: c.isNotNull(),
            )
        ),
    )
    # fixed value: one suffix and number per return flag
    flag = F.create_map(F.lit("A"), F.lit("_id"), F.lit("N"), F.lit("_key"), F.lit("R"), F.lit("_code"))
    place = F.create_map(F.lit("A"), F.lit(0), F.lit("N"), F.lit(1), F.lit("R"), F.lit(2))
    qty = F.col("l_quantity").cast("bigint")
    items = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity", "l_returnflag", "l_linenumber", "l_linestatus")
        .repartition("l_orderkey")  # the groups and the join with the orders need no other shuffle
        .groupBy("l_orderkey", qty.alias("q"), "l_returnflag")
        .agg(F.min("l_linenumber").alias("line"), F.min("l_linestatus").alias("status"))
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            (F.lit(10) + F.col("q") * 10 + place[F.col("l_returnflag")]).cast("bigint").alias("ordinal"),
            F.concat(F.lit("Q"), F.col("q").cast("string"), flag[F.col("l_returnflag")]).alias("column_name"),
            F.when(F.col("line") % 3 == 0, "varchar").when(F.col("status") == "O", "bigint").otherwise("int").alias(
                "dtype"
            ),
            F.lit(None).cast("string").alias("comment"),
        )
    )
    cols = own.unionByName(items)
    # a catalog is a stored table: the jobs read it several times
    out = cols.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("s")).alias("table_name"),
        F.col("o_orderkey").alias("table_pos"),
        "ordinal",
        "column_name",
        "dtype",
        F.lit(True).alias("nullable"),
        "comment",
    )
    return cut_lineage(out)


ORDER_LAKE_SQL = """
firsts AS (SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1),
olake AS (
  SELECT 'cust' || o.o_custkey AS source_id, 'order' || o.o_orderkey || 's' AS table_name, o.o_orderkey AS table_pos,
         c.ordinal, c.column_name, c.dtype, c.comment
  FROM orders o JOIN (
    SELECT o_orderkey, 0 AS ordinal, 'id' AS column_name, 'bigint' AS dtype, NULL AS comment FROM orders
    UNION ALL
    SELECT o_orderkey, 1, 'order' || CASE WHEN o_orderpriority = '5-LOW' THEN last_key ELSE first_key END || '_id', 'bigint',
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'FK -> order' || first_key || 's.id' END
    FROM orders JOIN firsts USING (o_custkey) WHERE CASE WHEN o_orderpriority = '5-LOW' THEN last_key ELSE first_key END <> o_orderkey
    UNION ALL
    SELECT l_orderkey, 10 + q * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END,
           'Q' || q || CASE l_returnflag WHEN 'A' THEN '_id' WHEN 'N' THEN '_key' ELSE '_code' END,
           CASE WHEN line % 3 = 0 THEN 'varchar' WHEN status = 'O' THEN 'bigint' ELSE 'int' END, NULL
    FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, min(l_linenumber) AS line,
                 min(l_linestatus) AS status FROM lineitem GROUP BY ALL)
  ) c ON c.o_orderkey = o.o_orderkey)
"""


def entity_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    lead_key = F.struct("o_orderkey", "l_linenumber", "l_suppkey")
    lead = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min(lead_key)["l_suppkey"].cast("string").alias("lead"))
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(lead, "c_custkey", "left")
    key = F.col("c_custkey").cast("string")
    supp = F.concat(F.lit("supplier"), F.col("lead"))
    note = F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("FK -> "), supp, F.lit("s."), supp, F.lit("_id"))
    )
    customers = cust.select(
        F.lit("crm").alias("source_id"),
        F.concat(F.lit("customer"), key, F.lit("s")).alias("table_name"),
        (F.lit(1_000_000_000_000) + F.col("c_custkey")).alias("table_pos"),
        F.inline(
            F.filter(
                F.array(
                    _col(0, F.concat(F.lit("customer"), key, F.lit("_id")), "bigint"),
                    F.when(F.col("lead").isNotNull(), _col(1, F.concat(supp, F.lit("_id")), "bigint", note)),
                ),
                lambda c: c.isNotNull(),
            )
        ),
    )
    keyed = orders.join(_firsts(orders), "o_custkey")
    first = F.concat(F.lit("order"), F.col("first_key").cast("string"))
    follow = (F.col("first_key") != F.col("o_orderkey")) & (F.col("o_orderpriority") == "1-URGENT")
    ref = F.when(follow, F.concat(F.lit("fk->"), first, F.lit("s."), first, F.lit("_key")))
    sales = keyed.select(
        F.lit("sales").alias("source_id"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("s")).alias("table_name"),
        (F.lit(2_000_000_000_000) + F.col("o_orderkey")).alias("table_pos"),
        F.inline(
            F.array(
                _col(0, F.concat(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("_id")), "bigint"),
                _col(1, F.concat(first, F.lit("_key")), "bigint", ref),
            )
        ),
    )
    skey = F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("procurement").alias("source_id"),
        F.concat(skey, F.lit("s")).alias("table_name"),
        (F.lit(3_000_000_000_000) + F.col("s_suppkey")).alias("table_pos"),
        F.inline(F.array(_col(0, F.concat(skey, F.lit("_id")), "int"))),
    )
    return cut_lineage(customers.unionByName(sales).unionByName(suppliers))


ENTITY_LAKE_SQL = """
firsts AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY 1),
leads AS (
  SELECT o_custkey, l_suppkey AS lead_key FROM (
    SELECT o_custkey, l_suppkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_suppkey) AS rn
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE rn = 1),
elake AS (
  SELECT 'crm' AS source_id, 'customer' || c_custkey || 's' AS table_name, 1000000000000 + c_custkey AS table_pos,
         0 AS ordinal, 'customer' || c_custkey || '_id' AS column_name, 'bigint' AS dtype, NULL AS comment
  FROM customer
  UNION ALL
  SELECT 'crm', 'customer' || c_custkey || 's', 1000000000000 + c_custkey, 1, 'supplier' || lead_key || '_id', 'bigint',
         CASE WHEN c_mktsegment = 'BUILDING'
              THEN 'FK -> supplier' || lead_key || 's.supplier' || lead_key || '_id' END
  FROM customer JOIN leads ON o_custkey = c_custkey
  UNION ALL
  SELECT 'sales', 'order' || o_orderkey || 's', 2000000000000 + o_orderkey, 0, 'customer' || o_custkey || '_id',
         'bigint', NULL FROM orders
  UNION ALL
  SELECT 'sales', 'order' || o_orderkey || 's', 2000000000000 + o_orderkey, 1, 'order' || first_key || '_key', 'bigint',
         CASE WHEN first_key <> o_orderkey AND o_orderpriority = '1-URGENT'
              THEN 'fk->order' || first_key || 's.order' || first_key || '_key' END
  FROM orders JOIN firsts USING (o_custkey)
  UNION ALL
  SELECT 'procurement', 'supplier' || s_suppkey || 's', 3000000000000 + s_suppkey, 0, 'supplier' || s_suppkey || '_id',
         'int', NULL FROM supplier)
"""


def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per customer table that has one."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("crm").alias("source_id"),
        F.concat(F.lit("customer"), F.col("vec_id").cast("string"), F.lit("s")).alias("table_name"),
        (F.lit(1_000_000_000_000) + F.col("vec_id")).alias("table_pos"),
        F.col("embedding").alias("vector"),
    )
