"""Sharding by fixed virtual slots.

Records are hashed into a few thousand slots once and for all.  Bytes are added up per slot, and
a small versioned table maps slots to shards.  Version 1 gives each slot, largest first, to the
least loaded shard; adding a shard edits the map: each old shard hands over slots until all hold
about the same, and no record moves between old shards.

The map has one row per slot, so its size is a parameter and it may be broadcast.

Defined results: a NULL text has no bytes, so size 1 and crc32 0; rows with a NULL key are
spread by their text; repeated rows meet in one slot and get different places in the shard; an
empty table gives no rows, and its map spreads the slots evenly.  Input columns named like an
added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record; depends on its key alone where it has one."""
    spare = F.concat(F.lit("?"), text_crc32(text).cast("string"))
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), spare)), F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) for every slot, also the empty ones, of rows (vslot, size)."""
    held = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").fillna(0, ["bytes", "n"])


def first_map(per_slot: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, vslot, bytes, n, shard); largest slot first, each to
    the shard that holds the fewest bytes so far."""
    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "n"))
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("given"),
    )

    def give(so_far: Column, slot: Column) -> Column:
        loads = so_far["loads"]
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        added = F.transform(
            loads, lambda x, i: x + F.when(i == least, slot["bytes"]).otherwise(F.lit(0))
        )
        return F.struct(
            added.alias("loads"), F.concat(so_far["given"], F.array(least)).alias("given")
        )

    one = per_slot.agg(ordered.alias("s")).withColumn(
        "given", F.aggregate("s", start, give)["given"]
    )
    return one.select(F.inline(F.arrays_zip("s", "given"))).select(
        F.lit(1).alias("version"), "s.vslot", "s.bytes", "s.n", F.col("given").alias("shard")
    )


def grown_map(old: DataFrame, shards: int) -> DataFrame:
    """Next version of the map, with shard number ``shards`` added to 0 .. shards-1."""
    fair = F.sum("bytes").over(Window.partitionBy("version")) / (shards + 1)
    filled = F.sum("bytes").over(
        Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    stays = F.col("filled") <= F.col("fair")
    return (
        old.withColumn("fair", fair)
        .withColumn("filled", filled)
        .select(
            (F.col("version") + 1).alias("version"),
            "vslot",
            "bytes",
            "n",
            F.when(stays, F.col("shard")).otherwise(F.lit(shards)).alias("shard"),
        )
    )


def write_map(slot_map: DataFrame, path: str) -> None:
    """Adds one version to the stored maps; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    at = version if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == at)


def assign(docs: DataFrame, slot_map: DataFrame, key="doc_id", text="text", slots=SLOTS):
    """``docs`` with vslot and shard; no exchange, the map is broadcast (one row per slot)."""
    keyed = docs.drop("shard").withColumn("vslot", virtual_slot(F.col(key), F.col(text), slots))
    return keyed.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")


def places(sized: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """``sized`` (vslot, ...) with shard and its place in the shard, from 0 without gaps.

    Rows are ranked within their virtual slot only; the slots before it in the same shard
    are counted from the map.
    """
    ahead = Window.partitionBy("shard").orderBy("vslot")
    starts = slot_map.select(
        "vslot", "shard", (F.sum("n").over(ahead) - F.col("n")).alias("ahead")
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    return (
        sized.join(F.broadcast(starts), "vslot")
        .withColumn("slot", (F.col("ahead") + rank - 1).cast("long"))
        .drop("ahead")
    )
