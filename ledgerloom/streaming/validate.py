"""Streams: documents are judged as they arrive, copies of files are linked, and findings are counted by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import DEFAULT, Rule
from ..sources.ubl import judge


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """k (the file's path) and xml of files as they arrive under ``path``."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("k"), F.col("value").alias("xml"))


def stream_findings(stream: DataFrame, path: str, checkpoint: str, run: str = "run", rules: list[Rule] = DEFAULT):
    """Start a query that judges each batch of ``stream`` (k, xml) at every grain. Findings go to ``path``/findings, documents
    without a verdict to ``path``/no_verdict, each under its run and batch: a batch that is repeated replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = judge(batch, rules).persist()
        for name, part in (("findings", found.where("outcome <> 'no_verdict'")), ("no_verdict", found.where("outcome = 'no_verdict'"))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/run={run}/batch={batch_id}")
        found.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LINKED = "tenant string, checksum string, file_id string, at timestamp, copy_of string"


def link_copies(arrivals: DataFrame, days: int = 90, late: str = "1 day") -> DataFrame:
    """Each arrival (tenant, checksum, file_id, at) with the stored file that it is a copy of, NULL if it is stored itself. The
    time to live runs from the stored file; a key's state is that file's id and time, and ends with it."""
    limit = pd.Timedelta(days=days)

    def link(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored, at = state.get if state.exists else (None, None)
        at = None if at is None else pd.Timestamp(at)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "file_id"], kind="stable")
        copies = []
        for file_id, time in zip(rows["file_id"], rows["at"]):
            if at is None or time - at >= limit:
                stored, at = file_id, time
                copies.append(None)
            else:
                copies.append(stored)
        state.update((stored, at.to_pydatetime()))
        state.setTimeoutTimestamp(max(int((at + limit).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(copy_of=copies)[["tenant", "checksum", "file_id", "at", "copy_of"]]

    keyed = arrivals.select("tenant", "checksum", "file_id", "at").withWatermark("at", late).groupBy("tenant", "checksum")
    return keyed.applyInPandasWithState(link, LINKED, "stored string, at timestamp", "append", "EventTimeTimeout")


def counts_by_window(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))
