"""Canonical invoices over the order tables, with seeded defects. One SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = """
SELECT l_orderkey AS k,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS line,
       l_suppkey, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS net, l_returnflag AS flag
FROM lineitem
"""

LINE_FIELDS = """
SELECT k, line, l_suppkey AS supplier, l_quantity AS quantity, net, CAST(net AS VARCHAR(40)) AS amount,
       CASE WHEN (k + line) % 31 = 0 THEN 'VAT' WHEN (k + line) % 41 = 0 THEN NULL WHEN flag = 'R' THEN 'S' WHEN flag = 'A' THEN 'Z' ELSE 'E' END AS tax_category,
       CASE WHEN (k + line) % 29 = 0 OR k % 163 = 0 THEN 'Nos.' ELSE 'H87' END AS unit,
       CASE WHEN (k + line) % 79 = 0 THEN '' ELSE 'item' END AS item_name
FROM numbered
"""

DOCS = """
SELECT o_orderkey AS k, o_custkey AS custkey,
       CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('INV-', CAST(o_orderkey AS VARCHAR(20))) END AS id,
       CASE WHEN o_orderkey % 53 = 0 THEN {dmy} ELSE {ymd} END AS issue_date,
       CASE WHEN o_orderkey % 61 = 0 THEN {before} ELSE {after} END AS due_date,
       CASE WHEN o_orderkey % 178 = 0 THEN 'ZZZ' WHEN o_orderkey % 89 = 0 THEN 'JPY' WHEN o_orderkey % 71 = 0 THEN lower(ccy) ELSE ccy END AS currency,
       CASE WHEN o_orderstatus = 'P' THEN '381' ELSE '380' END AS type_code,
       CASE WHEN o_orderstatus = 'P' THEN 'CreditNote' ELSE 'Invoice' END AS root,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN concat('INV-', CAST(o_orderkey - 1 AS VARCHAR(20))) END AS predecessor_ref,
       concat('1', lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 12, '0'), '03') AS plain_trn,
       CASE WHEN o_orderkey % 43 = 0 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 12, '0') WHEN o_orderkey % 47 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN NULL ELSE concat('1', lpad(CAST(o_custkey % 1000 AS VARCHAR(20)), 12, '0'), '02') END AS buyer_trn,
       CASE WHEN o_orderkey % 103 = 0 THEN '12345' ELSE concat('1', lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 12, '0'), '03') END AS seller_trn,
       'Seller' AS seller_name, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE c_name END AS buyer_name,
       CASE WHEN o_orderkey % 67 = 0 THEN 'ae' ELSE 'AE' END AS seller_country, CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE substr('AEOMBHSAFRDEPLESBEIN', CAST(1 + 2 * (c_nationkey % 10) AS INT), 2) END AS buyer_country,
       CASE WHEN o_orderkey % 109 = 0 THEN NULL ELSE 'urn:peppol:pint:billing-1' END AS customization_id, CASE WHEN o_orderkey % 113 = 0 THEN '' ELSE 'urn:peppol:bis:billing' END AS profile_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'PO' END AS order_ref, o_orderdate AS issued
FROM (SELECT o.*, c.c_name, c.c_nationkey, CASE WHEN o_custkey % 3 = 0 THEN 'AED' WHEN o_custkey % 3 = 1 THEN 'EUR' ELSE 'BHD' END AS ccy FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey) x
"""
SPARK = {"dmy": "date_format(o_orderdate, 'dd/MM/yyyy')", "ymd": "date_format(o_orderdate, 'yyyy-MM-dd')", "before": "date_format(date_sub(o_orderdate, 5), 'yyyy-MM-dd')", "after": "date_format(date_add(o_orderdate, 30), 'yyyy-MM-dd')"}
DUCK = {"dmy": "strftime(o_orderdate, '%d/%m/%Y')", "ymd": "strftime(o_orderdate, '%Y-%m-%d')", "before": "strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d')", "after": "strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')"}

#: Columns that follow from an invoice's key and its exact line sum.
STATED = """
       CASE WHEN k % 73 = 0 THEN concat(CAST(line_sum AS VARCHAR(40)), '0') WHEN k % 37 = 0 THEN CAST(CAST(line_sum + 1 AS DECIMAL(38,2)) AS VARCHAR(40)) ELSE CAST(line_sum AS VARCHAR(40)) END AS line_total,
       CAST(line_sum AS VARCHAR(40)) AS tax_exclusive, '0.00' AS tax_total,
       CASE WHEN k % 127 = 0 THEN CAST(CAST(line_sum + 2 AS DECIMAL(38,2)) AS VARCHAR(40)) ELSE CAST(line_sum AS VARCHAR(40)) END AS tax_inclusive,
       CASE WHEN k % 131 = 0 THEN '' ELSE CAST(line_sum AS VARCHAR(40)) END AS payable
"""
TOTALS = f"SELECT *, {STATED} FROM (SELECT d.*, t.n_lines, t.line_sum FROM doc_rows d JOIN (SELECT k, CAST(count(*) AS INT) AS n_lines, CAST(sum(net) AS DECIMAL(38,2)) AS line_sum FROM line_rows GROUP BY k) t ON d.k = t.k)"

#: DuckDB text of the views ``line_rows`` and ``invoices``.
DUCK_WITH = f"WITH numbered AS ({LINES}), line_rows AS ({LINE_FIELDS}), doc_rows AS ({DOCS.format(**DUCK)}), invoices AS ({TOTALS})"


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _net() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def _numbered(spark: SparkSession, sf_dir: str, totals: bool) -> DataFrame:
    """Lines with their number and, with ``totals``, the count and exact sum of their invoice: one exchange by invoice."""
    whole = Window.partitionBy("k")  # by the name that later steps use: a column beside it is another key to Spark, and exchanged again
    totals_of = [F.count(F.lit(1)).over(whole).cast("int").alias("n_lines"), F.sum(_net()).over(whole).cast("decimal(38,2)").alias("line_sum")] if totals else []
    number = F.row_number().over(whole.orderBy(*ORDER)).alias("line")
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "k")
    item = item.select("k", number, "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")  # before the sums: what is computed for these would travel too
    numbered = item.select("k", "line", "l_suppkey", "l_quantity", _net().alias("net"), F.col("l_returnflag").alias("flag"), *totals_of)
    text = LINE_FIELDS.replace("FROM numbered", "FROM {numbered}")
    if not totals:
        return spark.sql(text, numbered=numbered)
    rows = spark.sql(text.replace("SELECT k,", "SELECT k, n_lines, line_sum,"), numbered=numbered)
    return rows.withColumn("first_of_category", F.row_number().over(Window.partitionBy("k", "tax_category").orderBy("line")) == 1)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice line."""
    return _numbered(spark, sf_dir, False)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its header fields, without totals. Orders are exchanged by key as they are: the fields that
    follow from them are several times as wide."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    fields, source = DOCS.format(**SPARK).split("FROM (SELECT", 1)
    source = "SELECT" + source.replace("FROM orders o", "FROM {orders} o").replace("JOIN customer c", "JOIN {customer} c").rsplit(")", 1)[0]
    return spark.sql(fields + "FROM {x}", x=spark.sql(source, orders=orders, customer=customer).repartition("o_orderkey"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice with its header fields and exact line sum."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return with_totals(spark, sf_dir, item.groupBy(F.col("l_orderkey").alias("k")).agg(*sums(_net())))


def sums(net: Column) -> list[Column]:
    """What ``with_totals`` takes of an invoice's lines."""
    return [F.count(F.lit(1)).cast("int").alias("n_lines"), F.sum(net).cast("decimal(38,2)").alias("line_sum")]


def with_totals(spark: SparkSession, sf_dir: str, grouped: DataFrame) -> DataFrame:
    """Invoices with the columns of ``grouped``: k, ``sums`` and any others."""
    return spark.sql(f"SELECT *, {STATED} FROM {{joined}}", joined=headers(spark, sf_dir).join(grouped, "k"))


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice line that carries its invoice's fields as well: lines are exchanged once, for all grains."""
    return spark.sql(f"SELECT *, {STATED} FROM {{joined}}", joined=_numbered(spark, sf_dir, True).join(headers(spark, sf_dir), "k"))
