"""Streams over files that arrive late, twice or after a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import copies, deadlines, sinks

START = dt.datetime(2024, 1, 1)


def day(n, hour=0):
    return START + dt.timedelta(days=n, hours=hour)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_deadlines_equal_the_batch_answer_with_late_and_missing_responses(spark, tmp_path):
    one, two, out, check = (str(tmp_path / x) for x in ("invoices", "responses", "out", "check"))
    invoice, response = "k long, issued timestamp", "k long, sent timestamp"

    def run(checkpoint=check):
        deadlines.follow_deadlines(deadlines.table_stream(spark, one), deadlines.table_stream(spark, two), out, checkpoint, hours=240).awaitTermination()
        return spark.read.parquet(out)

    # 1: answered in time, by two responses; 2: late; 3: never; 4: answered at its last moment; 5: open; None: no time
    put(spark, one, [(1, day(0)), (2, day(0)), (3, day(1)), (4, day(2)), (6, None)], invoice)
    put(spark, two, [(1, day(3)), (1, day(2)), (4, day(12)), (9, day(1))], response)
    assert rows(run(), "k", "breached") == [(1, False), (4, False)]  # the watermark is at day 0: nobody is in breach yet
    put(spark, one, [(5, day(20))], invoice)
    put(spark, two, [(2, day(11)), (5, day(20, 1))], response)
    got = rows(run(), "k", "breached")
    assert got == [(1, False), (2, True), (3, True), (4, False), (5, False)]
    put(spark, one, [(7, day(30)), (8, day(40))], invoice)
    put(spark, two, [(3, day(39)), (8, day(45))], response)  # 3 is settled; this comes too late to change it
    run()
    final = spark.read.parquet(out)
    batch = deadlines.deadlines_at(spark.read.parquet(one), spark.read.parquet(two), F.lit(day(38)), hours=240)
    assert rows(final, "k", "breached") == rows(batch, "k", "breached") == [(1, False), (2, True), (3, True), (4, False), (5, False), (8, False)]
    assert rows(final, "k", "due") == rows(batch, "k", "due") and final.where("k = 1").first().sent == day(2)
    run(str(tmp_path / "lost"))  # the checkpoint is lost: all is read again, nothing is written twice
    assert rows(spark.read.parquet(out), "k", "breached") == rows(batch, "k", "breached")


def test_deadlines_keep_only_what_is_open_and_a_batch_may_run_again(spark, tmp_path):
    one, two, out, check = (str(tmp_path / x) for x in ("invoices", "responses", "out", "check"))
    put(spark, one, [(1, day(0)), (2, day(0)), (3, day(30)), (4, day(38))], "k long, issued timestamp")
    put(spark, two, [(1, day(3)), (2, day(15)), (9, day(39))], "k long, sent timestamp")
    query = deadlines.follow_deadlines(deadlines.table_stream(spark, one), deadlines.table_stream(spark, two), out, check, hours=240)
    query.awaitTermination()
    assert all(not p.stateOperators for p in query.recentProgress)  # no store in memory: what is open is a table
    assert rows(spark.read.parquet(f"{check}/open/0/issued"), "k") == [(3,), (4,)] and rows(spark.read.parquet(f"{check}/open/0/sent"), "k") == [(9,)]
    batch = spark.createDataFrame([(3, None, day(33)), (5, day(50), None), (2, None, day(51)), (6, day(1), None)], "k long, issued timestamp, sent timestamp")
    for _ in range(2):
        deadlines._settle(out, f"{check}/open", 240, "2 days")(batch, 1)  # 3's answer is late itself; 6 came too late
    assert rows(spark.read.parquet(out), "k", "breached") == [(1, False), (2, True), (3, True)]
    assert rows(spark.read.parquet(f"{check}/open/1/issued"), "k") == [(4,), (5,)]


ARRIVAL = "tenant string, checksum string, file_id string, at timestamp"


def test_copies_are_linked_over_restarts_and_never_written_twice(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run(checkpoint=check):
        copies.follow_copies(deadlines.table_stream(spark, source), out, checkpoint, days=10).awaitTermination()
        return sorted((r.file_id, r.copy_of) for r in spark.read.parquet(out).collect())

    put(spark, source, [("t", "x", "a", day(0)), ("t", "x", "b", day(3)), ("u", "x", "c", day(1)), ("t", "y", "d", day(1))], ARRIVAL)
    first = [("a", None), ("b", "a"), ("c", None), ("d", None)]
    assert run() == first
    put(spark, source, [("t", "x", "e", day(9)), ("t", "x", "f", day(11)), ("t", "x", "g", day(12)), ("t", "y", "h", day(10, 23))], ARRIVAL)
    second = [*first, ("e", "a"), ("f", None), ("g", "f"), ("h", "d")]
    assert run() == second  # state came back from the checkpoint
    put(spark, source, [("t", "z", "i", day(60))], ARRIVAL)
    run()
    put(spark, source, [("t", "x", "j", day(61))], ARRIVAL)  # after its timer: f is forgotten, and j is stored
    assert run() == [*second, ("i", None), ("j", None)]
    assert run(str(tmp_path / "lost")) == [*second, ("i", None), ("j", None)]  # all arrivals again, no row twice


def test_sink_keeps_the_first_of_a_key_and_reads_only_the_months_it_needs(spark, tmp_path):
    path = str(tmp_path / "store")
    write = sinks.append_new(path, ["k"], "month", "n")
    batch = spark.createDataFrame([(1, 5, dt.date(2024, 1, 1)), (1, 3, dt.date(2024, 1, 1)), (2, 1, dt.date(2024, 2, 1))], "k long, n int, month date")
    for _ in range(2):
        write(batch, 0)
    write(batch.limit(0), 1)
    assert rows(spark.read.parquet(path), "k", "n") == [(1, 3), (2, 1)]
    assert sinks.stored(spark, str(tmp_path / "never"), "k long").count() == 0
