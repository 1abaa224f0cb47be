"""Mixing sources to target weights with a time-varying curriculum (native).

Every source has a weight, which fixes how many words the mix takes from it, and a schedule,
which says when in training (time 0 to 1) they are read. A schedule is a piecewise linear
rate; its integral is the source's cumulative demand. A document starts where its source's
words laid end to end reach it; the inverse of the cumulative demand turns that place into a
training position, and documents are range-sorted by position.

Targets are water-filled: sources share ``SHARE`` of all words by weight, no source gives more
than ``REPEATS`` times its words, and what it can't give is shared again by weight.

Running totals inside a source never run over the source as a whole: documents are ordered by
the MD5 of their id, the first hex digits cut a source into buckets, and one row per source and
bucket carries the offsets. A source with most of the rows is spread over its buckets.

Defined results: a null text has no words; a null source is a source, the last; null ids and
repeated rows keep one place each (order by MD5 of the id, then size); documents without words
take none; no documents, no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Hex digits of the order key that make a bucket.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Schedule knots in training time, and the rates there by weight: heavy sources lead, light
#: ones hold, medium ones follow.
KNOTS = (0.0, 0.5, 1.0)
RATES = {3: (1.5, 1.0, 0.5), 1: (1.0, 1.0, 1.0), 2: (0.5, 1.0, 1.5)}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, ord, bucket) of every row.

    Rows alike in id, source and size can be exchanged: they are numbered, and all but the first, and rows without
    an id, are ordered by id, size and number, so that they spread over the buckets.
    With ``row_col``, a number that no other row has, also ``row`` and ``name`` (hash of id, text and source);
    rows without an id are then ordered by their name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       *([F.col(row_col).alias("row"), F.xxhash64(id_col, text_col, source_col).alias("name")] if row_col else []))
    given = F.col("doc_id").cast("string")
    if row_col:
        key, more = F.coalesce(given, F.col("name").cast("string")), ["row", "name"]
    else:
        rows, more = common.numbered_copies(rows), []
        key = F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), given).otherwise(F.concat_ws("#", F.coalesce(given, F.lit("")), "size", "copy"))
    ord_key = F.md5(key.cast("binary"))
    return rows.select("doc_id", "source", "size", ord_key.alias("ord"), F.substring(ord_key, 1, DIGITS).alias("bucket"), *more)


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, weight, source_size, target), one row per source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(nth, F.lit(len(weights))) + 1)
    every = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    ranked = (sums.select("source", "source_size", weight.alias("weight"))
              .withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
              .withColumn("cap", repeats * F.col("source_size"))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("weight_left", F.sum("weight").over(onward))
              .withColumn("full", F.col("cap") * F.col("weight_left").cast("double") <= (F.col("budget") - F.col("cap_before")) * F.col("weight")))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    full_cap = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("budget") - full_cap) / open_weight)
    return ranked.select("source", "weight", "source_size", target.alias("target"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source that come before a row's in MD5 order."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    ties = [c for c in ("name", "row") if c in rows.columns]
    inside = W.partitionBy("source", "bucket").orderBy("ord", "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(offsets, common.same(F.col("source"), F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
            .withColumn("start", F.col("offset") + F.col("before")).drop("o_source", "o_bucket", "offset", "before"))


def position(u: Column, weight: Column, knots: Sequence[float] = KNOTS, rates=RATES) -> Column:
    """Training time at which a source has met the fraction ``u`` of its demand."""

    def inverse(shape: Sequence[float]) -> Column:
        widths = [b - a for a, b in zip(knots, knots[1:])]
        area = sum(h * (a + b) / 2 for h, a, b in zip(widths, shape, shape[1:]))
        r = [x / area for x in shape]
        out, reached = None, 0.0
        for j, h in enumerate(widths):
            y = u - F.lit(reached)
            inside = F.lit(2.0) * y / (F.lit(r[j]) + F.sqrt(F.lit(r[j] * r[j]) + F.lit(2.0 * (r[j + 1] - r[j]) / h) * y))
            t = F.when(y <= 0, F.lit(float(knots[j]))).otherwise(F.lit(float(knots[j])) + inside)
            reached += h * (r[j] + r[j + 1]) / 2
            last = j == len(widths) - 1
            out = F.when(u <= F.lit(reached), t) if out is None else (out.otherwise(t) if last else out.when(u <= F.lit(reached), t))
        return out

    out = None
    for w, shape in rates.items():
        out = F.when(weight == w, inverse(shape)) if out is None else out.when(weight == w, inverse(shape))
    return out


def mix(docs: DataFrame, **names: str) -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, start, taken, position) of every row.

    ``taken`` counts the row's words in the mix: the source's words are read from the start,
    again after the last, up to the whole words of the target. ``position`` is the training
    time of the first of them, null if none is taken.
    """
    rows = common.written(sized(docs, **names))
    per_source = targets(rows).select(F.col("source").alias("t_source"), "weight", "source_size", "target")
    out = placed(rows).join(per_source, common.same(F.col("source"), F.col("t_source"))).drop("t_source")
    whole = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    for lap in range(REPEATS):
        left = whole - F.col("source_size") * lap - F.col("start")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    out = out.withColumn("taken", taken)
    return out.withColumn("position", F.when(F.col("taken") > 0, position(F.col("start") / F.col("target"), F.col("weight"))))


def mixed_order(mixed: DataFrame) -> DataFrame:
    """The contract's columns, range-sorted by training position."""
    cols = ["doc_id", "size", "source_size", "target", "taken", "position"]
    return mixed.select(*cols).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def epochs(docs: DataFrame) -> DataFrame:
    """The mixed training set: the rows of ``docs``, whole, once for each lap that reads them.

    A reading is in if its middle word is inside the target, so a source is off by half a
    document at most. Rows come in training order. Every row is read for itself: rows without an
    id, rows that share one and equal rows are told apart by a number that is written with them.
    """
    keyed = common.written(docs.select(common.whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")))
    m = mix(keyed.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row").where(F.col("target") > 0)
    lap = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    readings = m.select("row", "name", "size", "source_size", "target", "start", "weight", lap.alias("lap"))
    first = F.col("start") + F.col("lap") * F.col("source_size")
    at = position(F.least(first / F.col("target"), F.lit(1.0)), F.col("weight"))
    readings = readings.where(first + F.col("size") / 2 <= F.col("target")).select("row", "name", at.alias("position"), "lap")
    return keyed.join(readings, "row").orderBy("position", "doc.doc_id", "lap", "name").select("doc.*")


def mix_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mixed_order(mix(docs))
