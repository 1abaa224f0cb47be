"""Sharding by fixed virtual slots and a versioned slot-to-shard map (native).

Records hash into ``SLOTS`` virtual slots, a number that never changes. Bytes are summed per
slot, and a map of one row per slot says which shard a slot lives in. Rebalancing edits the
map: records never re-hash, and only the slots that the edit names move.

The map has ``SLOTS`` rows whatever the data size, so building and editing it is done on one
row holding an array of that length, and joining it is a join with a table of proven size.

Defined results: a null text has 0 text bytes; null ids hash like a value, together with the
text's checksum; repeated rows are rows of their own: rows alike in id, size and checksum are counted,
numbered and dealt over the slots by their number, so no slot gets more than its share of them; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm import common
from tenure.session import path_exists, shared_path

#: Virtual slots. Fixed for the life of a data set.
SLOTS = 4096
#: Bytes that a record costs beside its text.
OVERHEAD = 8

MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row; copies of a row are dealt over the slots after its own."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    every = docs.select(F.col(id_col).alias("doc_id"), (common.text_bytes(text_col) + OVERHEAD).alias("size"), crc.alias("text_crc32"))
    vslot = F.pmod(F.xxhash64("doc_id", "text_crc32") + F.col("copy"), F.lit(slots)).cast("int")
    return common.numbered_copies(every).select("doc_id", "size", "text_crc32", vslot.alias("vslot"))


def slot_bytes(spark: SparkSession, recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of every slot, empty ones included."""
    used = recs.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select(
        "vslot", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).alias("rows"))


def _lightest(load: Column) -> Column:
    return F.array_position(load, F.array_min(load)).cast("int") - 1


def _place(sorted_slots: Column, load: Column) -> Column:
    """Give slots, heaviest first, to the shard that is lightest at that moment."""
    start = F.struct(load.alias("load"), F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint>>").alias("out"))

    def step(acc: Column, slot: Column) -> Column:
        to = _lightest(acc["load"])
        return F.struct(
            F.transform(acc["load"], lambda v, i: F.when(i == to, v + slot["bytes"]).otherwise(v)).alias("load"),
            F.array_append(acc["out"], F.struct(slot["vslot"].alias("vslot"), to.alias("shard"), slot["bytes"].alias("bytes"))).alias("out"))

    return F.aggregate(sorted_slots, start, step, lambda acc: acc["out"])


def _heaviest_first(*keep: str) -> Column:
    """All slots in one array; its length is the fixed number of slots."""
    return F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("weight"), "vslot", "bytes", *keep)))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots by falling bytes, each to the lightest shard so far."""
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    one = loads.agg(_heaviest_first().alias("s")).select(F.explode(_place(F.col("s"), zero)).alias("m"))
    return one.select(F.lit(1).alias("version"), "m.vslot", "m.shard", "m.bytes")


def rebalanced(current: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """Next version: overfull shards give up slots until none is over the mean by ``slack``.

    A shard gives up its smallest slots first, and only as many as it has to; all other slots
    stay where they are. Shards that are new (``shards`` may have grown) start empty.
    """
    now = current.select("version", "vslot", "shard").join(loads.select("vslot", "bytes"), "vslot")
    limit = F.sum("bytes").over(W.partitionBy()) / shards * (1 + slack)
    by_shard = W.partitionBy("shard")
    # a shard's slots are stacked, the largest at the bottom; those above the limit move
    top = F.sum("bytes").over(by_shard.orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0))
    stacked = (now.withColumn("moves", (top > limit) & (F.col("bytes") > 0))
               .withColumn("stays", F.sum(F.when(~F.col("moves"), F.col("bytes")).otherwise(0)).over(by_shard)))
    moved, kept = F.filter("s", lambda x: x["moves"]), F.filter("s", lambda x: ~x["moves"])
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda i: F.coalesce(F.try_element_at("stays", i), F.lit(0).cast("long")))
    one = stacked.agg(_heaviest_first("shard", "moves").alias("s"), F.map_from_entries(F.collect_set(F.struct("shard", "stays"))).alias("stays"),
                      (F.max("version") + 1).cast("int").alias("version"))
    slots = F.concat(F.transform(kept, lambda x: F.struct(x["vslot"].alias("vslot"), x["shard"].alias("shard"), x["bytes"].alias("bytes"))), _place(moved, load))
    return one.select("version", F.explode(slots).alias("m")).select("version", "m.vslot", "m.shard", "m.bytes")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the last one unless named."""
    every = spark.read.parquet(path).select("version", "vslot", "shard", "bytes")
    if version is None:
        return every.join(every.agg(F.max("version").alias("version")), "version").select("version", "vslot", "shard", "bytes")
    return every.where(F.col("version") == version)


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its gapless place in the shard.

    Places run through a shard's virtual slots in order. Rows are only ordered inside a
    virtual slot; the offset of a slot comes from counts, one row per slot.
    """
    counts = recs.groupBy("vslot").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    offsets = (slot_map.select("version", "vslot", "shard").join(counts, "vslot")
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # one row per virtual slot: a table of at most SLOTS rows
    return (recs.withColumn("place", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets.select("version", "vslot", "shard", "offset")), "vslot")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"),
                    F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version")))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None, rebalance: bool = False) -> DataFrame:
    """All rows of ``docs`` in ``shards`` shards of near equal bytes, by the map stored at ``map_path``.

    Without a map there, version 1 is made and stored; a map that is there is used as it is, or edited to a next
    version with ``rebalance``. Without a path the map lives in the shared folder until the program ends.
    """
    recs = common.stored(records(docs, slots=slots))
    path = map_path or shared_path(spark, "slot-map")
    if not path_exists(spark, path):
        write_map(first_map(slot_bytes(spark, recs, slots), shards), path)
    elif rebalance:
        write_map(common.stored(rebalanced(read_map(spark, path), slot_bytes(spark, recs, slots), shards)), path)
    return assign(recs, read_map(spark, path))
