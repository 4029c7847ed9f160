"""Sharding by virtual slots and a versioned slot-to-shard map.

A record (id and text) is hashed to one of ``slots`` virtual slots, for good.  The copies of a row
are numbered and hashed with their number, so they spread over the slots however many
there are.  Bytes and rows are aggregated by slot; that histogram, ``slots`` rows whatever the
data, is all that reaches the driver.  Version 0 of the map deals out the slots evenly.  A
rebalancing edits the newest stored version: it moves, from the fullest shard to the emptiest,
the slot that closes the gap between them best, until no move helps, and stores the
edited map as the next version beside the old ones.  Records of slots that did not
move stay where they are, also in a later run on the same map.

Rows are numbered inside their shard without gaps: a slot's first number follows from
the histogram, so only rows of one slot are sorted together.  A null text has size 1
and the checksum of no bytes; null ids hash by their text; an empty table gives an even map and
no rows.  Only the named columns are read.
Nothing but DataFrame operations runs on the records.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

SLOTS, SHARDS = 4096, 16
MAP = "slot int, shard int, bytes bigint, n bigint, first bigint"


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row; the narrow rows are stored once on the way."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    rows = rows.select("*", F.xxhash64("doc_id", "text_crc32").alias("record"), F.monotonically_increasing_id().alias("row"))
    rows = Scratch(docs.sparkSession, "records").keep(rows, "sized")
    repeated = rows.groupBy("record").count().filter("count > 1").select("record")
    # copies are numbered part by part of the table, so no task holds all copies of a row
    copies = rows.join(repeated, "record", "left_semi").withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("record").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = copies.groupBy("record", "part").agg(F.count("*").alias("n")).select("record", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("record", "part").orderBy("row")) - 1
    numbered = copies.withColumn("at", at).join(parts, ["record", "part"]).withColumn("copy", F.col("first") + F.col("at"))
    alone = rows.join(repeated, "record", "left_anti")
    spread = F.when(F.col("copy") > 0, F.xxhash64("record", "copy")).otherwise(F.col("record"))
    whole = alone.withColumn("copy", F.lit(0).cast("long")).select("doc_id", "size", "text_crc32", "record", "copy").unionByName(
        numbered.select("doc_id", "size", "text_crc32", "record", F.col("copy").cast("long")))
    return whole.select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("virtual_slot"))


def loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in found}


def even_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    return {s: s * shards // slots for s in range(slots)}


def rebalance(current: dict[int, int], load: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """The map after moves of single slots from the fullest to the emptiest shard."""
    out = dict(current)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in out.items():
        if load.get(slot, (0, 0))[0]:
            held[shard][slot] = load[slot][0]
    total = [sum(h.values()) for h in held]
    while True:
        low = min(range(shards), key=lambda s: (total[s], s))
        moved = False
        for high in sorted(range(shards), key=lambda s: (-total[s], s)):
            gap = total[high] - total[low]
            fits = [(abs(gap - 2 * b), slot) for slot, b in held[high].items() if b < gap]
            if fits:
                slot = min(fits)[1]
                b = held[high].pop(slot)
                held[low][slot] = b
                total[high] -= b
                total[low] += b
                out[slot] = low
                moved = True
                break
        if not moved:
            return out


def store_map(spark: SparkSession, path: str, version: int, current: dict[int, int], load: dict[int, tuple[int, int]]) -> DataFrame:
    """Writes path/version=N and returns it: each slot's shard, load and first row number."""
    base: dict[int, int] = {}
    rows = []
    for slot in sorted(current):
        shard, (size, n) = current[slot], load.get(slot, (0, 0))
        rows.append({"slot": slot, "shard": shard, "bytes": size, "n": n, "first": base.get(shard, 0)})
        base[shard] = base.get(shard, 0) + n
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{MAP.replace(' ', ':').replace(',:', ',')}>>")).alias("x")).select("x.*")
    # a version is never rewritten once it is whole
    table.coalesce(1).write.mode("errorifexists" if version in versions(spark, path) else "overwrite").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions stored at ``path``, rising."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [f.getPath().getName() for f in files.listStatus(root)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS")))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with their shard and their number in it; the map has a row per slot, so it is broadcast."""
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(w) - 1)
    slots = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "first")
    return numbered.join(F.broadcast(slots), "virtual_slot").withColumn("slot", (F.col("first") + F.col("at")).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version."""
    spark = docs.sparkSession
    path = map_path or Scratch(spark, "slotmap").path("map")
    rows = sized(docs, slots=slots)
    load = loads(rows)
    known = versions(spark, path)
    if known:
        current = {r["slot"]: r["shard"] for r in read_map(spark, path, known[-1]).collect()}
        if len(current) != slots or max(current.values()) >= shards:
            raise ValueError(f"the stored map has {len(current)} slots on {max(current.values()) + 1} shards, asked for are {slots} on {shards}")
    else:
        known, current = [0], even_map(slots, shards)
        store_map(spark, path, 0, current, load)
    version = known[-1] + 1
    edited = store_map(spark, path, version, rebalance(current, load, shards), load)
    return place(rows, edited).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
