"""Purge of client data over its tables. *Ours*: the reference lists the tables and leaves the job to others.

Tables are stored by the month in which their rows expire, so that a purge touches expired months only: months that are
over go as folders, and the month of ``as_of`` is written anew without its expired rows. No row passes the driver; the
number of folders is the number of months that expired since the last purge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables that are purged, and the one that is not, since earlier runs rest on it.
TABLES = (
    "ingestion_run", "raw_document", "invoice", "invoice_line", "master_data_defect", "finding", "exception", "exception_comment", "report", "notification_delivery", "purchase_order", "goods_receipt", "ap_match", "lifecycle_response",
    "supplier_readiness", "gl_entry", "vat_return", "reconciliation_run", "divergence",
)
EXEMPT = ("mapping_profile",)
MONTH = "expires_in"


def store(rows: DataFrame, path: str, expires: Column) -> None:
    """Append ``rows`` to the table at ``path`` with ``expires_at`` and, as its folders, the month of it. A row without a date never
    expires."""
    dated = rows.withColumn("expires_at", expires.cast("timestamp")).withColumn(MONTH, F.date_format("expires_at", "yyyy-MM"))
    dated.repartition(MONTH, F.pmod(F.xxhash64("expires_at", *rows.columns[:1]), F.lit(4))).write.mode("append").partitionBy(MONTH).parquet(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str, month: str) -> list:
    """The month's folder, its old and its fresh one; Spark's readers skip the latter two."""
    return [_fs(spark, f"{path}/{name}")[0] for name in (f"{MONTH}={month}", f"_old-{month}", f"_fresh-{month}")]


def _finish(spark: SparkSession, path: str, month: str) -> None:
    """Put the fresh files in place of the old folder, or drop them if the old folder was not set aside yet. Each step may be the
    last of a purge that is cut short: what is appended meanwhile stays, and the next purge goes on from there."""
    current, old, fresh = _folders(spark, path, month)
    fs = _fs(spark, path)[1]
    if fs.exists(old) and fs.exists(fresh):
        fs.mkdirs(current)
        for status in fs.listStatus(fresh):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(current, status.getPath().getName()))
    fs.delete(fresh, True)
    fs.delete(old, True)


def purge_table(spark: SparkSession, path: str, as_of: dt.datetime) -> dict[str, int]:
    """kept and purged rows of one table at ``as_of``; rows that expire then or earlier are gone afterwards. Counts are taken before
    anything is removed; a purge that was cut short is finished by the next, and one that is repeated purges nothing."""
    root, fs = _fs(spark, path)
    if not fs.exists(root):
        return {"kept": 0, "purged": 0}
    month, at = as_of.strftime("%Y-%m"), F.lit(as_of).cast("timestamp")
    for name in {s.getPath().getName().split("-", 1)[1] for s in fs.listStatus(root) if s.getPath().getName().startswith(("_old-", "_fresh-"))}:
        _finish(spark, path, name)
    rows = spark.read.option("inferSchema", False).parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > at)
    n = rows.agg(F.count_if(live).alias("kept"), F.count_if(~live).alias("purged")).first()
    current, old, _ = _folders(spark, path, month)
    if fs.exists(current):
        rows.where((F.col(MONTH) == month) & live).drop(MONTH).write.parquet(f"{path}/_fresh-{month}")
        fs.rename(current, old)
        _finish(spark, path, month)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{MONTH}=") and name.split("=")[1] < month and name.split("=")[1][:1].isdigit():
            fs.delete(status.getPath(), True)
    return {"kept": n.kept, "purged": n.purged}


def purge(spark: SparkSession, root: str, as_of: dt.datetime, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """table, kept and purged of every table under ``root``; a table that is exempt is refused, one that was never written is empty."""
    if wrong := set(tables) & set(EXEMPT):
        raise ValueError(f"{min(wrong)} is never purged")
    counts = [(t, *purge_table(spark, f"{root}/{t}", as_of).values()) for t in tables]
    return spark.createDataFrame(counts, "table string, kept long, purged long")
