"""Registers, scores and reconciliations. Operators that the tables only declare carry our own semantics (marked *ours*)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def insert_or_nothing(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` to append: first of each key that is not there yet."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def tenant_scope(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; without a tenant none."""
    return df.where(F.lit(False) if tenant is None else F.col(column) == tenant)


def catalogue_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, changed or same for each rule_id by text_hash."""
    o, n = old.select("rule_id", F.col("text_hash").alias("o")), new.select("rule_id", F.col("text_hash").alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("same")
    return o.join(n, "rule_id", "full_outer").select("rule_id", state.alias("state"))


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ttl_dedup(arrivals: DataFrame, key: list[str], at: str, days: int) -> DataFrame:
    """arrivals and stored: how many arrivals each key has and how many are kept. The time to live restarts at each stored
    arrival, so a fold over the sorted times of a key decides. It holds a key's last stored time and two counters only;
    arrivals without a time are not counted."""
    limit, width = days * 86_400_000_000, len(key)
    times = arrivals.select(*key, F.unix_micros(F.col(at).cast("timestamp")).alias("__t")).groupBy(*key, "__t").agg(F.count("__t").alias("__n"))
    fields = StructType([*times.select(*key).schema, StructField("arrivals", IntegerType()), StructField("stored", IntegerType())])

    def same(a: tuple, b: tuple) -> bool:
        return all(x == y or (x != x and y != y) for x, y in zip(a, b))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = kinds = None
        n = kept = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*kinds, pa.int32(), pa.int32()])], names=fields.names)

        for b in batches:
            kinds, done = b.schema.types[:width], []
            for *of, t, count in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or not same(now, of):
                    if now is not None:
                        done.append((*now, n, kept))
                    now, last, n, kept = of, None, 0, 0
                n += count
                if t is not None and (last is None or t - last >= limit):
                    last, kept = t, kept + 1
            if done:
                yield batch(done)
        if now is not None:
            yield batch([(*now, n, kept)])

    return times.repartition(*key).sortWithinPartitions(*key, "__t").mapInArrow(fold, fields)


def supplier_readiness(found: DataFrame, documents: DataFrame, key: str, at: str) -> DataFrame:
    """*Ours*: documents, failing share, most frequent failing rule (lowest id on a tie) and time of the last failing
    document of each ``key``. found and documents: k, ``key``, ``at``. Findings are counted once per key and rule."""
    failing = found.where("outcome = 'fail'").groupBy("k", key, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("at"))
    failing = failing.withColumn("first", F.row_number().over(Window.partitionBy("k").orderBy("rule_id")) == 1)  # a document counts once
    rules = failing.groupBy(key, "rule_id").agg(F.sum("n").alias("n"), F.count_if("first").alias("failed"), F.max("at").alias("at"))
    worst = rules.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "rule_id")).alias("top"), F.sum("failed").alias("failed"), F.max("at").alias("last_breach"))
    total = documents.groupBy(key).agg(F.count(F.lit(1)).alias("documents"))
    share = F.round(F.coalesce("failed", F.lit(0)) / F.col("documents"), 4).alias("fail_rate")
    return total.join(worst, key, "left").select(key, "documents", share, F.col("top.rule_id").alias("top_rule"), "last_breach")


def reconcile(ledger: DataFrame, invoices: DataFrame, ref: str = "ref", amount: str = "amount", drift: int = 1) -> DataFrame:
    """*Ours*: divergence class of each reference that one side lacks or that differs; equal ones are left out."""
    l, i = ledger.select(ref, F.col(amount).alias("in_ledger")), invoices.select(ref, F.col(amount).alias("in_invoice"))
    gap = F.abs(F.col("in_ledger") - F.col("in_invoice"))
    kind = F.when(F.col("in_ledger").isNull(), "invoice_not_in_ledger").when(F.col("in_invoice").isNull(), "ledger_not_in_invoice").when((gap > 0) & (gap <= drift), "rounding_drift").when(gap > drift, "amount_mismatch")
    return l.join(i, ref, "full_outer").select(ref, kind.alias("divergence")).where("divergence is not null")


def expiry(at: Column, days: int = 90) -> Column:
    """When client data that was received then expires: whole days of 24 hours."""
    return at + F.make_dt_interval(F.lit(days))


def archive_until(at: Column, years: int = 7) -> Column:
    """When an archived document may go: calendar years; the last of February stays one."""
    return F.add_months(at, 12 * years)


def retention(df: DataFrame, expires: str, as_of) -> DataFrame:
    """*Ours*: kept and purged rows at ``as_of``."""
    return df.agg(F.count_if(F.col(expires) > as_of).alias("kept"), F.count_if(~(F.col(expires) > as_of)).alias("purged"))


def retention_by_table(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """*Ours*: kept and purged rows of each table (with ``expires_at``)."""
    return reduce(DataFrame.unionByName, [retention(df, "expires_at", as_of).withColumn("table", F.lit(name)) for name, df in tables.items()])
