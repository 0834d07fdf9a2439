"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's slot never changes: it follows from a hash of its text, so equal texts stay
together. Bytes are added up for each slot, and a versioned map gives every slot its shard.
Rebalancing edits the map, not the hash: only the records of slots that move are copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlode.llm.common import durable, newest_version

SLOTS = 4096
#: A text whose copies hold more than 1 / HOT_SHARE of the bytes or rows is spread over slots.
HOT_SHARE = 64


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_key) of every row.

    size is the text's UTF-8 bytes plus 1; a null text has none, and the crc of the empty text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
    )


def hot_texts(slim: DataFrame) -> DataFrame:
    """(text_key): texts whose copies pass a share of all bytes or rows; 2 * HOT_SHARE at most."""
    total_bytes, total_rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    copies = slim.groupBy("text_key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return copies.where(
        (F.col("n") > 1)
        & ((F.col("b") * HOT_SHARE > F.lit(total_bytes)) | (F.col("n") * HOT_SHARE > F.lit(total_rows)))
    ).select(F.col("text_key").alias("hot_key"))


def with_slots(slim: DataFrame) -> DataFrame:
    """Adds vslot: by text, and for hot texts by text and doc_id.

    At most HOT_SHARE texts can pass either share, so the table of those is broadcast.
    """
    by_text = F.pmod(F.xxhash64("text_key"), F.lit(SLOTS))
    by_row = F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(SLOTS))
    marked = slim.join(F.broadcast(hot_texts(slim)), F.col("text_key") == F.col("hot_key"), "left")
    return marked.select(
        "doc_id", "size", "text_crc32",
        F.when(F.col("hot_key").isNotNull(), by_row).otherwise(by_text).cast("int").alias("vslot"),
    )


def slot_sizes(placed: DataFrame) -> DataFrame:
    """(vslot, bytes, n): at most SLOTS rows."""
    return placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sizes: dict[int, int], shards: int) -> list[int]:
    """Shard of each slot: largest first, each to the shard with the fewest bytes so far."""
    load = [0] * shards
    chosen = [slot % shards for slot in range(SLOTS)]
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        chosen[slot] = min(range(shards), key=lambda shard: (load[shard], shard))
        load[chosen[slot]] += sizes[slot]
    return chosen


def rebalanced(chosen: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The map edited for a number of shards: slots leave shards that are dropped, or that hold
    more than a lighter one would with them. New shards, where there are some, are the only
    ones that take slots from shards that stay."""
    edited = list(chosen)
    load = [0] * shards
    homeless = []
    for slot in range(SLOTS):
        if edited[slot] < shards:
            load[edited[slot]] += sizes.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        edited[slot] = min(range(shards), key=lambda shard: (load[shard], shard))
        load[edited[slot]] += sizes.get(slot, 0)
    takers = sorted(set(range(shards)) - set(chosen)) or range(shards)
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        light = min(takers, key=lambda shard: (load[shard], shard))
        if load[edited[slot]] - sizes[slot] >= load[light] + sizes[slot]:
            load[edited[slot]] -= sizes[slot]
            edited[slot] = light
            load[light] += sizes[slot]
    return edited


def map_table(spark: SparkSession, chosen: list[int], version: int) -> DataFrame:
    """(version, vslot, shard): SLOTS rows of one version of the map."""
    text = F.lit(",".join(map(str, chosen)))
    return spark.range(1).select(
        F.lit(version).alias("version"), F.posexplode(F.split(text, ",")).alias("vslot", "shard")
    ).select("version", "vslot", F.col("shard").cast("int").alias("shard"))


def store_map(spark: SparkSession, path: str, chosen: list[int]) -> int:
    """Write the next version of the map under path and return its number, 1 for the first.

    Earlier versions stay, so readers of one keep it while the next is made.
    """
    version = (newest_version(spark, path) or 0) + 1
    map_table(spark, chosen, version).drop("version").coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot) as stored, the newest unless one is named: SLOTS numbers."""
    number = newest_version(spark, path) if version is None else version
    rows = spark.read.parquet(f"{path}/version={number}").select("vslot", "shard").collect()
    return number, [shard for _, shard in sorted(tuple(row) for row in rows)]


def rebalance(spark: SparkSession, path: str, placed: DataFrame, shards: int) -> DataFrame:
    """Edit the newest map for a number of shards, store it as the next version and return the
    records that have to be copied: those of placed (with vslot) whose slot changed its shard,
    with from_shard and to_shard. All other records stay where they are.
    """
    sizes = {row["vslot"]: row["bytes"] for row in slot_sizes(placed).collect()}
    _, before = load_map(spark, path)
    store_map(spark, path, edited := rebalanced(before, sizes, shards))
    moves = [(slot, old, new) for slot, (old, new) in enumerate(zip(before, edited)) if old != new]
    moved = spark.createDataFrame(moves, "moved_slot int, from_shard int, to_shard int")
    return placed.join(F.broadcast(moved), F.col("vslot") == F.col("moved_slot")).drop("moved_slot")


def place(placed: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, gapless from 0.

    The place is the number of rows in the shard's earlier virtual slots plus the place within
    the virtual slot, so no task sorts a shard. sizes and the map have SLOTS rows at most.
    """
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "vslot").select(
        F.col("vslot").alias("start_slot"), "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), F.col("vslot") == F.col("start_slot")).select(
        "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")
    )


def shards(docs: DataFrame, count: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot) of every row.

    The law is `bytes`: slots are dealt to shards by their bytes, so sizes come out nearly
    equal. Equal texts share a shard, unless their copies alone pass a 64th of all bytes or
    rows. Nulls count as empty texts without bytes; rows without doc_id are placed too; equal
    rows follow each other. An empty table gives no rows. Only the sizes of the slots, SLOTS
    numbers whatever the input, reach the driver.
    """
    placed = durable(with_slots(durable(records(docs), "shard-records")), "shard-slots")
    sizes = durable(slot_sizes(placed), "slot-sizes")
    known = {row["vslot"]: row["bytes"] for row in sizes.collect()}
    slot_map = map_table(docs.sparkSession, first_map(known, count), 1)
    return place(placed, sizes, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
