"""Helpers the operators share: tables, cut lineage, bounded broadcasts, null-safe joins."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.session import checkpointed, remove_written, written, written_by_key, written_so_far  # noqa: F401  (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; lost executors cost no recomputation."""
    return checkpointed(df)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced, and give free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_name(docs: DataFrame) -> Column:
    """Names a row by id and text; rows that are equal in both share it."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, whatever they are called; beside it no name can clash."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def only_rows(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose name is in the one column of ``names``; no column is added, so none can clash."""
    return docs.join(names, row_name(docs) == names[names.columns[0]], "left_semi")


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Copies of a row that are listed in one place.
COPIES = 4096


def numbered_copies(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``: 0, 1, ... among rows that are equal in all columns.

    Equal rows can be exchanged, so they are counted, with partial sums before the shuffle, and listed again; no window
    ever holds them. The copies of a row that has many are listed in parts, dealt anew.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    few = counted.where(F.col("_n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    parts = counted.where(F.col("_n") > COPIES).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    last = F.least(F.col("_at") + COPIES, F.col("_n")) - 1
    many = parts.repartition(partitions(rows.sparkSession), *rows.columns, "_at").withColumn("copy", F.explode(F.sequence("_at", last)))
    return few.select(*rows.columns, "copy").unionByName(many.select(*rows.columns, "copy"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_slices(batch: pa.RecordBatch, rows: int, size: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``rows`` rows and about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + size, "right"))
        to = max(at + 1, min(to, at + rows))
        yield batch.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


def split_words(texts: pa.Array) -> pa.ListArray:
    """Texts split at white space. Nothing is left at their ends first: after a separator that ends the last text, the
    kernel reads the byte behind the buffer, and if no character can open with it the word before keeps its separator.
    """
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table of at most ``rows`` rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


#: Keys that ``join_facts`` broadcasts at most.
HOT_KEYS = 100_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, times: str) -> DataFrame:
    """Join one table row per key to ``rows``; ``times`` counts the rows of a key.

    A key with over a ``HOT_KEYS``-th of all rows would meet in one task: there are fewer than ``HOT_KEYS`` of them, so
    their facts are broadcast. All other keys shuffle. ``facts`` is read several times and should be stored.
    """
    total = facts.agg(F.sum(times)).first()[0] or 0
    limit = max(10_000, total // HOT_KEYS + 1)
    hot, cold = facts.where(F.col(times) >= limit), facts.where(F.col(times) < limit)
    return (rows.join(F.broadcast(hot), key)
            .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)))
