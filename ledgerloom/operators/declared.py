"""Work that the reference's tables only declare; the semantics here are *ours*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ap_match(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, tolerance: int = 0) -> DataFrame:
    """State of each invoice (counterparty, number, payable, quantity, seq) against its purchase order (amount) and
    receipt (received): duplicate, no_po, price_variance, qty_variance, matched_2way or matched_3way."""
    key = ["counterparty", "number"]
    copy = F.row_number().over(Window.partitionBy(*key, "payable").orderBy("seq")) > 1
    joined = invoices.withColumn("copy", copy).join(orders.select(*key, "amount"), key, "left").join(receipts.select(*key, "received"), key, "left")
    state = (
        F.when(F.col("copy"), "duplicate").when(F.col("amount").isNull(), "no_po").when(F.abs(F.col("payable") - F.col("amount")) > tolerance, "price_variance")
        .when(F.col("received").isNull(), "matched_2way").when(F.col("received") != F.col("quantity"), "qty_variance").otherwise("matched_3way")
    )
    return joined.select("seq", *key, state.alias("state"))


def trading_edges(documents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """documents and distinct edges of each jurisdiction pair; documents: issuer, receiver, from, to (names, or their keys with ``names``:
    key, name). Edges hardly repeat, so rows are exchanged before they are counted: counted where they are read, a task
    would hold an edge for each row of its file split."""
    edges = documents.repartition("issuer", "receiver").groupBy("issuer", "receiver", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("documents"))
    if names is not None:
        for side in ("from", "to"):
            pairs = pairs.join(F.broadcast(names.select(F.col("key").alias(side), F.col("name").alias(f"{side}_name"))), side).drop(side).withColumnRenamed(f"{side}_name", side)
    return pairs.groupBy(F.concat_ws(">", "from", "to").alias("jurisdiction_pair")).agg(F.sum("edges").alias("edges"), F.sum("documents").alias("documents"))


def breached(due: Column, sent: Column, as_of: Column) -> Column:
    """Whether a response is late: not sent by now, or sent after it was due."""
    return (sent.isNull() & (as_of > due)) | F.coalesce(sent > due, F.lit(False))


def exception_queue(failures: DataFrame, as_of: Column, sla_days: int = 14) -> DataFrame:
    """One open row per recurrence key: documents, first seen, overdue. failures: recurrence_key, k, occurred_at."""
    queue = failures.groupBy("recurrence_key").agg(F.count_distinct("k").alias("documents"), F.min("occurred_at").alias("first_seen"))
    return queue.withColumn("overdue", F.date_add(F.to_date("first_seen"), sla_days) < as_of)


def recurred_after(fixes: DataFrame, failures: DataFrame) -> DataFrame:
    """Each fix (recurrence_key, resolved_at) and whether a failure with its key came later: the last failure of a key decides."""
    last = failures.groupBy("recurrence_key").agg(F.max("occurred_at").alias("last"))
    late = F.coalesce(F.col("last") > F.col("resolved_at"), F.lit(False))
    return fixes.join(last, "recurrence_key", "left").select("recurrence_key", "resolved_at", late.alias("recurred"))


def recurrence_stats(failures: DataFrame, key: list[str], entity: str, least: int = 3) -> DataFrame:
    """Occurrences, entities, first and last sight of each key; keys of fewer than ``least`` entities are left out."""
    out = failures.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(entity).alias("entities"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))
    return out.where(F.col("entities") >= least)


def fix_stats(fixes: DataFrame, least: int = 3) -> DataFrame:
    """Fixes, median effort and share that recurred of each action (action, effort, recurred); fewer than ``least`` are left out."""
    out = fixes.groupBy("action").agg(F.count(F.lit(1)).alias("fixes"), F.median("effort").alias("median_effort"), F.round(F.avg(F.col("recurred").cast("double")), 6).alias("recurrence_rate"))
    return out.where(F.col("fixes") >= least)


def reconcile_returns(documents: DataFrame, returns: DataFrame) -> DataFrame:
    """Divergence of documents (ref, period, amount, credit) from the returns (ref, period, amount) that list them:
    invoice_not_in_return, credit_note_timing (another period), return_exceeds_invoices; agreeing ones are left out."""
    r = returns.select("ref", F.col("period").alias("in_period"), F.col("amount").alias("in_return"))
    kind = (
        F.when(F.col("in_return").isNull(), "invoice_not_in_return").when(F.col("credit") & (F.col("in_period") != F.col("period")), "credit_note_timing")
        .when(F.col("in_return") > F.col("amount"), "return_exceeds_invoices")
    )
    return documents.join(r, "ref", "left").select("ref", kind.alias("divergence")).where("divergence is not null")


def magnitude(amount: Column, total: Column) -> Column:
    ratio = F.abs(amount) / F.nullif(F.abs(total), F.lit(0))
    return F.when(ratio < 0.001, "<0.1%").when(ratio < 0.01, "0.1-1%").when(ratio < 0.05, "1-5%").when(ratio >= 0.05, ">5%")


def revenue_mix(bills: DataFrame) -> DataFrame:
    """Billed, collected and recurring sums by month. bills: month, amount, recurring, collected."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("amount"))), F.lit(0))
    return bills.groupBy("month").agg(F.sum("amount").alias("billed"), part("collected").alias("collected"), part("recurring").alias("recurring"))


def capacity_trigger(weeks: DataFrame, key: str, capacity: float, share: float = 0.7, run: int = 3) -> DataFrame:
    """Stretches of at least ``run`` consecutive weeks above ``share`` of the capacity. weeks: key, week, used."""
    busy = weeks.where(F.col("used") > share * capacity)
    island = F.col("week") - F.row_number().over(Window.partitionBy(key).orderBy("week"))
    out = busy.withColumn("island", island).groupBy(key, "island").agg(F.min("week").alias("from_week"), F.count(F.lit(1)).alias("weeks"))
    return out.where(F.col("weeks") >= run).drop("island")


def late_issuance(documents: DataFrame, issued: str, received: str, days: int = 14) -> DataFrame:
    """Documents received more than ``days`` after their issue date."""
    return documents.where(F.date_diff(received, issued) > days)
