"""Filter interaction audit: what every order of a set of filters removes, from additive mask counts.

A document's failures are a bit mask, one bit per filter. Four filters look at the text alone. The
fifth needs the whole table: a text that some smaller id also has. For it a counting Bloom filter runs
first: every text counts up two counters of one 64-counter block, counters of all tasks are added, and
a text with a counter below two is unique for certain. Only the other texts shuffle, whole, to find the
smallest id of each text exactly. Masks are then counted per part, together with the labels, and every
order and step is a sum over the 32 counts of a part: no order reads documents again.

Skew: texts meet by ``groupBy`` on the text, so copies collapse inside the tasks that read them; the ids
come back by (text, id), which no group of copies shares. Rows with equal id, part, mask and text are
counted together before the labels join them. The sketch has 16 counters for each document; its blocks
with a repeat are broadcast up to a checked number and joined by a shuffle beyond.

Defined results: a null text is the empty text (and a copy of any other empty or null one); a null part
is the empty string; a row without an id is no copy and makes none; rows with equal id and text are not copies of
each other; a document is good or toxic if any of its label rows says so, and a row without an id has no
label; repeated label rows count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Counters of the sketch for each document, and counters in a block.
COUNTERS, BLOCK = 16, 64
#: Blocks of the sketch that are broadcast at most.
BROADCAST_BLOCKS = 2_000_000


def text_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone: too short, repetitive, capitals, markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    fails = [
        n < 200,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3,
        text.rlike(r"[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks).cast("long"))


def _counters(h: Column) -> tuple[Column, Column]:
    """The two counters of a text in its block; bits that do not choose the block."""
    more = F.xxhash64(h)
    first = more.bitwiseAND(BLOCK - 1).cast("int")
    step = F.shiftrightunsigned(more, 6).bitwiseAND(BLOCK // 2 - 1).cast("int") * 2 + 1
    return first, F.pmod(first + step, F.lit(BLOCK))


def repeat_sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, again): per block the counters that reached two, as bits, from the column ``h``.

    Counters are added inside the tasks first and then over all tasks.
    """
    first, second = _counters(F.col("h"))
    counts = (hashes.select(_block(F.col("h"), blocks).alias("block"), F.explode(F.array(first, second)).alias("i"))
              .groupBy("block", "i").agg(F.count("*").alias("n")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    return counts.where("n > 1").groupBy("block").agg(F.bit_or(bit).alias("again"))


def with_possible(rows: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """Adds ``possible``: false if the text with hash ``h`` is unique for certain."""
    first, second = _counters(F.col("h"))

    def at_two(i: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.col("again"), i).bitwiseAND(1) == 1

    found = rows.withColumn("block", _block(F.col("h"), blocks)).join(sketch, "block", "left")
    return found.withColumn("possible", F.coalesce(at_two(first) & at_two(second), F.lit(False))).drop("block", "again")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows with that id and part fail exactly the filters of the mask."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = common.written(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("name")))
    blocks = max(1, small.count() * COUNTERS // BLOCK)
    sketch = common.broadcast_if_small(common.stored(repeat_sketch(small, blocks)), BROADCAST_BLOCKS)
    flagged = with_possible(small, sketch, blocks)

    texts = with_possible(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")), sketch, blocks)
    first = (texts.where("possible").groupBy("text").agg(F.min("doc_id").alias("first"))
             .select(F.unhex(F.sha2("text", 256)).alias("f_name"), "first"))
    again = flagged.where("possible").groupBy("doc_id", "part", "mask", "name").agg(F.count("*").alias("n"))
    is_first = (F.col("name") == F.col("f_name")) & (F.col("doc_id") == F.col("first"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    again = again.join(first, is_first, "left").select(
        "doc_id", "part", (F.col("mask") + F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"), "n")
    unique = flagged.where("NOT possible").select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    return again.unionByName(unique).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def with_steps(rows: DataFrame) -> DataFrame:
    """Every row with each order of the filters and each step: the step's bit, and the bits before it."""
    orders = " ".join("".join(o) for o in permutations(FILTERS))
    spread = rows.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = [(F.instr("filter_order", name), 1 << bit) for bit, name in enumerate(FILTERS)]
    none = F.lit(0)
    return (spread.withColumn("bit", sum((F.when(at == F.col("step"), bit).otherwise(0) for at, bit in bits), none))
            .withColumn("before", sum((F.when(at < F.col("step"), bit).otherwise(0) for at, bit in bits), none)))


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row per part, order and step, zeros included."""
    counts = common.stored(mask_counts(masks(docs, **names), labels))
    spread = with_steps(counts)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(what: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    rows = spread.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    # a part has 120 rows for each filter
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")
