"""Sinks that a repeated batch, a restart or a lost checkpoint cannot make write a row twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What lies under ``path``; nothing if it was never written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def append_new(path: str, key: list[str], month: str, first_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that appends the rows whose ``key`` is not there yet, under their month (a date column that
    follows from the key). Of rows of one key in a batch the first by ``first_by`` is taken. Only the months of the batch are
    read back, and Spark publishes a batch's files when all are written: what a failed attempt left is not seen, what a
    finished one left is not written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        span = batch.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).first()
        if span.lo is not None:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            known = stored(spark, path, fields).where(F.col(month).between(F.lit(span.lo), F.lit(span.hi))).select(*key)
            others = sorted((c for c in batch.columns if c not in key), key=lambda c: c != first_by)
            rows = batch.groupBy(*key).agg(F.min(F.struct(*others)).alias("__r")).select(*key, *[F.col("__r")[c].alias(c) for c in others])
            new = rows.join(known, key, "left_anti").select(*batch.columns).repartition(month, F.pmod(F.xxhash64(*key), F.lit(4)))  # few files a month
            new.write.mode("append").partitionBy(month).parquet(path)
        batch.unpersist()

    return write
