import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.purge import TABLES, purge, purge_table, store


def test_expired_months_go_and_the_current_one_is_rewritten(spark, tmp_path):
    root, at = str(tmp_path), lambda m, d: dt.datetime(2024, m, d)
    rows = [(1, at(1, 5)), (2, at(2, 28)), (3, at(3, 1)), (4, at(3, 15)), (5, at(3, 16)), (6, at(9, 1)), (7, None)]
    df = spark.createDataFrame(rows, "id long, received timestamp")
    for table in ("invoice", "finding", "mapping_profile"):
        store(df, f"{root}/{table}", F.col("received"))
    got = {r.table: (r.kept, r.purged) for r in purge(spark, root, at(3, 15)).collect()}
    assert set(got) == set(TABLES) and len(TABLES) == 19 and got["invoice"] == got["finding"] == (3, 4) and got["report"] == (0, 0)
    left = lambda t: sorted(r.id for r in spark.read.parquet(f"{root}/{t}").collect())
    assert left("invoice") == left("finding") == [5, 6, 7] and left("mapping_profile") == [1, 2, 3, 4, 5, 6, 7]
    assert purge_table(spark, f"{root}/invoice", at(3, 15)) == {"kept": 3, "purged": 0} and left("invoice") == [5, 6, 7]
    store(df.where("id = 5"), f"{root}/invoice", F.col("received"))
    assert purge_table(spark, f"{root}/invoice", at(12, 1)) == {"kept": 1, "purged": 3} and left("invoice") == [7]
    # a purge that was cut short, after its old folder was set aside and before, with rows appended since
    for t in ("report", "divergence"):
        store(df.where("id in (4, 5)"), f"{root}/{t}", F.col("received"))
    table = tmp_path / "report"
    spark.read.parquet(str(table / "expires_in=2024-03")).where("id = 5").write.parquet(str(table / "_fresh-2024-03"))
    (table / "expires_in=2024-03").rename(table / "_old-2024-03")
    spark.read.parquet(f"{root}/divergence/expires_in=2024-03").where("id = 5").write.parquet(f"{root}/divergence/_fresh-2024-03")
    for t in ("report", "divergence"):
        store(df.where("id = 5").withColumn("id", F.lit(8).cast("long")), f"{root}/{t}", F.col("received"))
    assert [purge_table(spark, f"{root}/{t}", at(3, 15)) for t in ("report", "divergence")] == [{"kept": 2, "purged": 0}, {"kept": 2, "purged": 1}]
    assert left("report") == left("divergence") == [5, 8] and not [x for t in ("report", "divergence") for x in (tmp_path / t).iterdir() if x.name.startswith(("_old", "_fresh"))]
    with pytest.raises(ValueError):
        purge(spark, root, at(3, 15), ("mapping_profile",))
