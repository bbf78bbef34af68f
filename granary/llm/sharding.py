"""Sharding by fixed virtual slots. [native]

Records hash into a fixed number of virtual slots; bytes and rows are summed per slot; a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map, never the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SLOTS = 4096
SHARDS = 8


def slot_of(*key: str, slots: int = SLOTS) -> F.Column:
    """The virtual slot of a key of one or more columns; a null key has one too."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each used slot, from columns vslot and size. At most `slots` rows, whatever the input."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def all_slots(sizes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot_sizes() with a row for every slot; unused ones have zeros."""
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sizes), "vslot", "left").na.fill(0, ["bytes", "rows"])  # at most `slots` rows


def balanced_map(sizes: DataFrame, shards: int = SHARDS, version: int = 1, slots: int = SLOTS) -> DataFrame:
    """The first version of the map, with every slot: in order of falling bytes, each to the shard with the fewest
    bytes so far, unused ones to the shard with the fewest slots. Columns: vslot, shard, base, version.

    The fold runs over the slot table, whose length the number of slots bounds. Ties: lower slot first, then
    lower shard first. `base` is the number of rows that earlier slots put into the same shard.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "vslot", "rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"),
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("count"),
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("held"),
        F.expr("cast(array() as array<struct<vslot:int,shard:int,base:bigint>>)").alias("map"),
    )

    def put(acc, s):
        two = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        order = F.zip_with(acc["load"], acc["held"], lambda x, n: F.when(s["b"] == 0, two(n, x)).otherwise(two(x, n)))
        lightest = F.array_position(order, F.array_min(order)).cast("int")
        add = lambda a, x: F.transform(a, lambda v, i: F.when(i + 1 == lightest, v + x).otherwise(v))
        return F.struct(
            add(acc["load"], -s["b"]).alias("load"),
            add(acc["count"], s["rows"]).alias("count"),
            add(acc["held"], F.lit(1).cast("bigint")).alias("held"),
            F.concat(acc["map"], F.array(F.struct(s["vslot"].alias("vslot"), (lightest - 1).alias("shard"), F.element_at(acc["count"], lightest).alias("base")))).alias("map"),
        )

    folded = all_slots(sizes, slots).agg(order.alias("slots")).select(F.explode(F.aggregate("slots", start, put, lambda acc: acc["map"])).alias("m"))
    return folded.select("m.*", F.lit(version).alias("version"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, for one shard more than `shards`: from each old shard the smallest used slots, in order of
    bytes and slot, go to the new one until it has given 1/(shards + 1) of its bytes; no other slot moves.

    Slots without rows stay where they are. Columns: vslot, shard, version; every slot of the map is in it.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("shard")
    upto = w.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = slot_map.select("vslot", "shard", "version").join(F.broadcast(sizes), "vslot", "left").na.fill(0, ["bytes"])
    moved = (F.col("bytes") > 0) & (F.sum("bytes").over(upto) * (shards + 1) <= F.sum("bytes").over(w))
    return held.select("vslot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Stores a version beside the others; one that is there already is replaced, so that a repeated write does no harm."""
    version = slot_map.select("version").first()[0]
    slot_map.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest where none is named."""
    maps = spark.read.option("mergeSchema", True).parquet(path)
    return maps.where(F.col("version") == (F.lit(version) if version is not None else F.lit(maps.agg(F.max("version")).first()[0])))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with its shard and its place there, by a map that is stored as version 1 below
    `path` (by default in the shared folder) and read from there.

    Size: UTF-8 bytes of the text plus 1; a null text has none and counts 1. Law `bytes`: the shards' sizes are
    near equal. A record's slot comes from its doc_id and text, so that neither null nor repeated doc_ids fill one
    slot; rows that repeat both share it. `slot` numbers the rows of a shard from 0 without gaps, ordered by virtual
    slot, then doc_id; repeated rows each get a number of their own. An empty table gives no rows; further columns
    are ignored. A row longer than a shard's fair share makes its shard larger; nothing is cut.
    """
    from pyspark.sql import Window

    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("vslot", slot_of("doc_id", "text_crc32", slots=slots))
    sizes = scratch.written(slot_sizes(rows.select("vslot", "size")), "sizes")
    path = path or f"{scratch.place}/maps"
    write_map(balanced_map(sizes, shards, slots=slots), path)
    placed = F.broadcast(read_map(docs.sparkSession, path, 1))  # `slots` rows
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rn", F.row_number().over(within))
    return numbered.join(placed, "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version",
    )


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
