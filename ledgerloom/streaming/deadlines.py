"""Response deadlines as a stream: invoices and responses are joined as they arrive, and a breach is told once time is up.

Each batch joins its invoices and those still open with its responses and the recent ones. The watermark is the lesser of both
sides' latest times, less ``late``; a batch's late rows are those at or before the watermark of the batches before it, and are
left out. A response between an invoice's issue and its deadline answers it at once; an invoice without one leaves the open
ones when the watermark passes its deadline, and that is the breach: a response that comes after the deadline does not match,
and one that is missing never did. What is open lies as tables beside the checkpoint, one folder a batch, and is joined like
any table, so no batch has to fit in memory; it is bounded by the invoices and responses of one deadline's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .sinks import append_new, drop_folder, stored

FIELDS = "k long, due timestamp, sent timestamp, breached boolean, due_in date"


def _settle(path: str, state: str, hours: int, late: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer. It reads what batch n - 1 left open and overwrites what n leaves, so a batch may run again."""
    append = append_new(path, ["k"], "due_in", "sent")
    limit = F.expr(f"issued + INTERVAL {int(hours)} HOURS")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, now = f"{state}/{batch_id - 1}", f"{state}/{batch_id}"
        was = stored(spark, f"{before}/times", "issued timestamp, sent timestamp, mark timestamp").first()
        fields = {f.name: f.dataType.simpleString() for f in batch.schema}
        seen = batch.agg(F.max("issued").alias("issued"), F.max("sent").alias("sent"))
        if was is not None:
            seen = seen.select(*[F.greatest(c, F.lit(was[c]).cast("timestamp")).alias(c) for c in ("issued", "sent")])
        mark = F.when(F.col("issued").isNotNull() & F.col("sent").isNotNull(), F.least("issued", "sent") - F.expr(f"INTERVAL {late}"))
        seen.withColumn("mark", mark).write.mode("overwrite").parquet(f"{now}/times")
        mark = F.lit(spark.read.parquet(f"{now}/times").first().mark).cast("timestamp")
        fresh = lambda c: F.lit(True) if was is None or was.mark is None else F.col(c) > F.lit(was.mark)

        def side(time: str) -> DataFrame:
            kept = stored(spark, f"{before}/{time}", f"k {fields['k']}, {time} timestamp")
            return batch.where(F.col(time).isNotNull() & fresh(time)).select("k", time).unionByName(kept)

        responses = side("sent")
        answered = answers(side("issued"), responses, hours).withColumn("open", F.col("sent").isNull() & F.coalesce(limit >= mark, F.lit(True)))
        answered.write.mode("overwrite").partitionBy("open").parquet(f"{now}/joined")
        joined = spark.read.schema(answered.schema).parquet(f"{now}/joined")
        joined.where("open").select("k", "issued").write.mode("overwrite").parquet(f"{now}/issued")
        responses.where(F.coalesce(F.col("sent") >= mark, F.lit(True))).write.mode("overwrite").parquet(f"{now}/sent")
        append(joined.where("NOT open").select("k", limit.alias("due"), "sent", F.col("sent").isNull().alias("breached"), F.trunc(limit, "MM").alias("due_in")), batch_id)
        drop_folder(spark, f"{now}/joined")
        drop_folder(spark, f"{state}/{batch_id - 2}")  # batch n - 1 is committed

    return write


def follow_deadlines(invoices: DataFrame, responses: DataFrame, path: str, checkpoint: str, hours: int = 732, late: str = "2 days") -> StreamingQuery:
    """Start the stream into ``path``: each invoice once, with its earliest answer of the batch that settled it: k, due, sent,
    breached and due_in (the month). invoices: k, issued; responses: k, sent. Invoices without a time and responses without an
    invoice give nothing."""
    none = F.lit(None).cast("timestamp")
    one = invoices.select("k", F.col("issued").cast("timestamp").alias("issued"), none.alias("sent"))
    both = one.unionByName(responses.select("k", none.alias("issued"), F.col("sent").cast("timestamp").alias("sent")))
    return both.writeStream.foreachBatch(_settle(path, f"{checkpoint}/open", hours, late)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def answers(invoices: DataFrame, responses: DataFrame, hours: int = 732) -> DataFrame:
    """k, issued and ``sent``, the earliest response in time, of each invoice that has a time."""
    limit = F.expr(f"issued + INTERVAL {int(hours)} HOURS")
    match = (F.col("of") == F.col("k")) & (F.col("sent") >= F.col("issued")) & (F.col("sent") <= limit)
    return invoices.where("issued is not null").join(responses.select(F.col("k").alias("of"), "sent"), match, "left").groupBy("k", "issued").agg(F.min("sent").alias("sent"))


def deadlines_at(invoices: DataFrame, responses: DataFrame, watermark: Column, hours: int = 732) -> DataFrame:
    """The same over tables, as of ``watermark``: k, due, sent, breached of the invoices that are settled."""
    limit = F.expr(f"issued + INTERVAL {int(hours)} HOURS")
    best = answers(invoices, responses, hours)
    return best.where(F.col("sent").isNotNull() | (limit < watermark)).select("k", limit.alias("due"), "sent", F.col("sent").isNull().alias("breached"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files. The path is given as a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
