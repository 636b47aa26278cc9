"""Sharding through fixed virtual slots [DataFrame functions only].

Records hash into a fixed number of virtual slots (thousands). Bytes are summed per slot, and a small versioned
table maps each slot to a shard; rebalancing edits that table and never rehashes a record. The map has as many
rows as there are slots, whatever the data's size, so it is the one table that is broadcast.

A record's slot comes from its id and text. Records that are equal in both would share a slot; where they are more than any
slot should hold (CROWDED), their place in the table decides too, so no slot, and no sort of a slot's rows, is larger than
others. Such records are interchangeable.

Version 1 deals the slots round. Version 2 is version 1 edited for equal bytes: slots are gone through from the
largest down; a slot stays where it is while its shard has room under the mean, else it goes to the shard that is
least full. Equal sizes go by slot number, so the same input always gives the same map.

Edge cases. Null or empty text: size 1, crc32 of no bytes. Null ids and rows that repeat an id are dealt by their texts.
Rows of a slot get their places in the order of id, size and crc; between equal rows any order is as good. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, table, written

SLOTS = 4096
SHARDS = 16
#: Copies of a record are crowded if there are more of them than this share of what a slot holds on average, and than LEAST.
CROWDED, LEAST = 1 / 4, 16


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot, as a written table; text goes no further than the scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("key"),
    ), "sized")
    total = rows.count()
    # At most slots / CROWDED keys, whatever the number of rows.
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(LEAST, CROWDED * total / slots)).select("key", F.lit(True).alias("crowded"))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(crowded), "key", "left")
    slot = F.when(F.col("crowded"), F.xxhash64("key", "place")).otherwise(F.col("key"))
    return dealt.select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each slot, the empty slots too: `slots` rows."""
    spark = rows.sparkSession
    summed = rows.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    every = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(summed, "vslot", "left").na.fill(0, ["slot_bytes", "slot_rows"])


def initial_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, edited so that the shards' bytes come near equal.

    One fold over an array of as many entries as there are slots (a fixed number) that carries the shards' loads.
    """
    joined = slot_map.join(sizes, "vslot")
    one = joined.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "vslot", "shard"))).alias("all"),
        (F.sum("slot_bytes") / shards).alias("mean"),
        (F.max("version") + 1).alias("version"),
    )

    def step(state, entry):
        size, own = -entry["less"], entry["shard"]
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        to = F.when(F.get(state["loads"], own) + size <= F.col("mean"), own).otherwise(least)
        loads = F.transform(state["loads"], lambda load, i: load + F.when(i == to, size).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))
    done = one.withColumn("to", F.aggregate("all", start, step, lambda state: state["to"]))
    each = done.select("version", F.explode(F.arrays_zip(F.col("all").alias("e"), F.col("to").alias("t"))).alias("z"))
    return each.select("version", F.col("z.e.vslot").alias("vslot"), F.col("z.t").alias("shard"))


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more: each shard hands its last slots to the new one, no other slot moves."""
    w = Window.partitionBy("shard").orderBy("vslot")
    counted = slot_map.withColumn("n", F.row_number().over(w)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("shard")))
    moved = F.col("n") > F.col("of") - F.floor(F.col("of") / (shards + 1))
    return counted.select((F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def store_map(versions: list[DataFrame], path: str) -> DataFrame:
    """Append each version to the stored map and return the whole history."""
    for v in versions:
        v.write.mode("append").parquet(path)
    return versions[0].sparkSession.read.schema(versions[0].schema).parquet(path)


def latest(history: DataFrame) -> DataFrame:
    last = history.agg(F.max("version").alias("version"))
    return history.join(F.broadcast(last), "version")


def placed(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each row's shard and its place there, gapless from 0.

    Places need no sort of a whole shard: rows are numbered within their virtual slot, and each slot starts after
    the rows of the shard's slots before it, a running sum over the small map.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "vslot").select("vslot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("first") + F.col("nth"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Shards of near equal bytes. Returns doc_id, size, text_crc32, vslot, shard, slot."""
    rows = slotted(docs, slots)
    sizes = written(slot_bytes(rows, slots), "slot-bytes")
    first = initial_map(docs.sparkSession, slots, shards)
    history = store_map([first, rebalanced(first, sizes, shards)], fresh_dir(docs.sparkSession, "slot-map"))
    return placed(rows, latest(history), sizes).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot")


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
