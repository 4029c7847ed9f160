"""Stand-ins for the transaction tables, read from the generated parquet
tables (``<sf_dir>/<name>.parquet``).

``events`` becomes a card-transaction table: id = event_id, card_number =
user_id (as text, like a card number column), ts = ts, amount = value,
vendor_code = the ``k`` field of ``props`` (digits as text), event_type,
fraud = 1 for ``error`` events.  ``orders`` joined with ``customer`` and
``nation`` gives a second one with whole-day timestamps (ties).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("card_number"),
        F.col("ts"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").alias("vendor_code"),
        F.col("event_type"),
        (F.col("event_type") == "error").cast("int").alias("fraud"),
    )


EVENT_TRANSACTIONS_SQL = """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS card_number, ts, value AS amount,
       json_extract_string(props, '$.k') AS vendor_code, event_type,
       CAST(event_type = 'error' AS INTEGER) AS fraud
FROM events"""


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # customer and nation are dimension tables joined on their keys; Spark's
    # size statistics decide broadcast versus shuffle join.
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("card_number"),
                    F.col("o_orderdate").alias("ts"),
                    F.col("o_totalprice").alias("amount"),
                    F.col("n_name").alias("country_name"),
                    F.col("o_orderpriority").alias("priority"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("fraud")))


ORDER_TRANSACTIONS_SQL = """
SELECT o_orderkey AS id, o_custkey AS card_number, o_orderdate AS ts, o_totalprice AS amount,
       n_name AS country_name, o_orderpriority AS priority,
       CAST(o_orderstatus = 'F' AS INTEGER) AS fraud
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
