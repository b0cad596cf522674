"""The training-data pipeline: quality, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import load, materialize
from ledgerloom.llm.near_dedup import drop_near_duplicates
from ledgerloom.llm.packing import op7_packing
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.secret_scan import redact_secrets
from ledgerloom.llm.substring_dedup import drop_repeated_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_dedup", lambda spark, docs, sf_dir: drop_near_duplicates(docs)),
    ("substring_dedup", lambda spark, docs, sf_dir: drop_repeated_passages(docs)),
    ("secrets", lambda spark, docs, sf_dir: redact_secrets(docs)),
    ("packing", lambda spark, docs, sf_dir: op7_packing(docs)),
]

#: Signatures, forests and tokenizers are beyond SQL; tests/llm holds each stage against what it must keep, cut or redact.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
