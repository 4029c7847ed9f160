from datetime import datetime

from pyspark.sql import functions as F

from fraudframe.sources import tables as T
from fraudframe.sources.sinks import append_unlabelled, write_table
from fraudframe.sources.replay import scratch_dir
from fraudframe.sources.testdata import event_transactions
from tests.conftest import SF001


def test_catalog_listing(spark):
    event_transactions(spark, SF001).createOrReplaceTempView("tx_view_for_test")
    assert "default" in T.list_schemas(spark)
    assert "tx_view_for_test" in T.list_tables(spark)
    assert T.field_types(event_transactions(spark, SF001))[0] == ("id", "bigint")


def test_page_and_scans(spark):
    df = spark.createDataFrame([(3, "a", datetime(2024, 1, 2, 3, 4, 5, 6)), (1, "b", datetime(2024, 1, 1)),
                                (2, "a", datetime(2024, 1, 3)), (2, "z", datetime(2024, 1, 4))],
                               "id long, card string, ts timestamp")
    assert T.keyed_scan(df, "id").count() == 3
    kept = [T.keyed_scan(df.orderBy(order), "id").filter("id = 2").first()["card"]
            for order in (F.col("ts"), F.col("ts").desc())]
    assert kept == ["a", "a"]
    assert [r["id"] for r in T.page(df, "id", limit=5, after=1).collect()] == [2, 2, 3]
    p = T.page(df.dropDuplicates(["id"]), "id", limit=1, offset=2).collect()
    assert p[0]["id"] == 3 and p[0]["ts"] == "2024-01-02 03:04:05:000006"
    assert [r["id"] for r in T.newest_first(df, "ts").collect()][0] == 2
    got = T.lookback_scan(df, "card", "a", "ts", datetime(2024, 1, 2), "id").collect()
    assert [r["id"] for r in got] == [2, 3]


def test_sinks(spark):
    base = scratch_dir(spark, "sinks")
    df = spark.createDataFrame([(1, 2.0, 1.0)], "id long, x double, fraud double")
    write_table(df, base + "/t")
    append_unlabelled(df.drop("fraud"), base + "/t", "fraud")
    back = spark.read.parquet(base + "/t")
    assert back.count() == 2 and back.filter(F.col("fraud").isNull()).count() == 1
