"""Queries that run as streams over the given tables to their end, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streaming import deadlines, sinks

HOURS = 732


def response_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as invoices, shipments as their responses: who was answered in time, and who was in breach by the last watermark."""
    orders = deadlines.table_stream(spark, f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("issued"))
    shipped = deadlines.table_stream(spark, f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("sent"))
    path, checkpoint = (sinks.shared_folder(spark, f"deadlines-{x}") for x in ("out", "log"))
    deadlines.follow_deadlines(orders, shipped, path, checkpoint, hours=HOURS).awaitTermination()
    return sinks.stored(spark, path, deadlines.FIELDS).select("k", "due", "breached")


QUERIES = (response_deadlines,)


def oracles() -> dict[str, str]:
    limit = f"CAST(o_orderdate AS TIMESTAMP) + INTERVAL {HOURS} HOUR"
    return {
        "response_deadlines": "WITH w AS (SELECT least((SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders), (SELECT max(CAST(l_shipdate AS TIMESTAMP)) FROM lineitem)) - INTERVAL 2 DAY AS mark), "
                              f"a AS (SELECT o_orderkey AS k, {limit} AS due, count(l_shipdate) > 0 AS answered FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= {limit} GROUP BY ALL) "
                              "SELECT k, due, NOT answered AS breached FROM a, w WHERE answered OR due < mark",
    }
