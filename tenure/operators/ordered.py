"""Order-dependent operators without a single global window.

A window ordered over a whole table runs in one task. Here rows are first collapsed
to distinct values, then cut into value ranges whose edges are literals; running
totals are taken inside each range and shifted by the totals of the ranges before it.
Literal edges keep the ranges the same when a task is run again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def n_ranges(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def sketch(df: DataFrame, col: str, n: int | None = None) -> tuple[list[float], int]:
    """At most n - 1 range edges from an approximate quantile sketch, and the row count."""
    n = n or n_ranges(df)
    probs = [i / n for i in range(1, n)]
    value = F.col(col).cast("double")
    row = df.where(value.isNotNull()).agg(
        F.percentile_approx(value, probs, 20 * n).alias("cuts"), F.count("*").alias("n")).first()
    return sorted({float(c) for c in (row.cuts or []) if math.isfinite(c)}), row.n


def cut_points(df: DataFrame, col: str, n: int | None = None) -> list[float]:
    return sketch(df, col, n)[0]


def with_range(df: DataFrame, col: str, cuts: Sequence[float], out: str = "_range") -> DataFrame:
    """Index of the value range a row falls in."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *cuts, math.inf]
    staged = df.withColumn(f"{out}_x", F.col(col).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol=f"{out}_x", outputCol=f"{out}_d",
                          handleInvalid="keep").transform(staged)
    return bucketed.withColumn(out, F.col(f"{out}_d").cast("int")).drop(f"{out}_x", f"{out}_d")


def prefix_sum(df: DataFrame, order: str, vals: Mapping[str, Column], by: Sequence[str] = (),
               descending: bool = False, cuts: Sequence[float] | None = None) -> DataFrame:
    """Running totals in value order, one row per distinct (by, order).

    Adds ``cum_<name>`` (inclusive) for each entry of ``vals``. ``by`` must have few
    distinct values: the range totals kept are groups x ranges.
    """
    by = list(by)
    if cuts is None:
        cuts = cut_points(df, order)
    collapsed = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(
        *[F.sum(c).alias(n) for n, c in vals.items()])
    ranged = with_range(collapsed, order, cuts)
    if descending:
        ranged = ranged.withColumn("_range", -F.col("_range"))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in vals])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, F.col("_range"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in vals])
    if not by:
        # one row per range: the number of ranges is the bound
        offsets = F.broadcast(offsets)
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*by, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    running = ranged.withColumns({f"_r_{n}": F.sum(n).over(inside) for n in vals})
    out = running.join(offsets, [*by, "_range"])
    return out.select(*by, order, *vals,
                      *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in vals])


def row_index(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based position of each distinct key in key order, as (by, key, rn)."""
    one = prefix_sum(df.select(*by, key).distinct(), key, {"n": F.lit(1)}, by=by)
    return one.select(*by, key, F.col("cum_n").alias("rn"))


def quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation at any number of distinct values."""
    by = list(by)
    rows = df.select(*by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    cuts, total = sketch(rows, "_v")
    counts = prefix_sum(rows, "_v", {"n": F.lit(1)}, by=by, cuts=cuts)
    if by:
        totals = rows.groupBy(*by).agg(F.count("_v").alias("_total"))
        counts = counts.join(totals, by)
    else:
        counts = counts.withColumn("_total", F.lit(total))
    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        k = F.floor(pos)
        aggs.append(F.min(F.when(F.col("cum_n") >= k + 1, F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("cum_n") >= F.least(k + 2, F.col("_total")), F.col("_v")))
                    .alias(f"_hi{i}"))
    picked = counts.groupBy(*by).agg(*aggs)
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
                     * (pos - F.floor(pos))).alias(name))
    return picked.select(*by, *outs)


def rank_average(df: DataFrame, col: str, out: str, descending: bool = False,
                 by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value, as (by, col, out)."""
    counts = prefix_sum(df, col, {"n": F.lit(1)}, by=by, descending=descending)
    return counts.select(*by, col, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(out))


def ranges_and_heavy(df: DataFrame, col: str) -> tuple[list[float], list[float]]:
    """Range edges, and the values that fill a range or more on their own.

    A value that so many rows share stands at two or more of the sketch's quantiles. There are at most
    as many of them as ranges. Only types in which equal doubles mean equal values are looked at.
    """
    n = n_ranges(df)
    probs = [i / n for i in range(n + 1)]
    value = F.col(col).cast("double")
    found = df.where(value.isNotNull()).agg(F.percentile_approx(value, probs, 20 * n).alias("cuts")).first().cuts or []
    points = [float(c) for c in found if math.isfinite(c)]
    exact = df.schema[col].dataType.typeName() in ("double", "float", "byte", "short", "integer", "long")
    heavy = sorted({a for a, b in zip(points, points[1:]) if a == b and abs(a) < 2**53}) if exact else []
    return sorted({*points[1:-1], *heavy}), heavy


def with_rank(df: DataFrame, col: str, out: str, descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Attach the average rank of ``col`` to every row; null values have none.

    Rows are ranked where they are: a window inside each value range, shifted by the totals of
    the ranges before it. Rows of a value that would fill a range take their rank from that value's totals, one row
    per range, and are not moved. ``by`` must have few distinct values.
    """
    by = list(by)
    cuts, heavy = ranges_and_heavy(df, col)
    is_heavy = F.coalesce(F.col(col).cast("double").isin(heavy), F.lit(False)) if heavy else F.lit(False)
    rows = with_range(df.withColumn("_heavy", is_heavy), col, cuts)
    known = rows.where(F.col(col).isNotNull())
    # groups x ranges rows: a heavy value is the first of its range
    sizes = known.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.count_if("_heavy").alias("_h"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), "_h",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(W.partitionBy(*by)).alias("_all")))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = W.partitionBy(*by, "_range").orderBy(col)
    peers = F.count(F.lit(1)).over(inside.rangeBetween(W.currentRow, W.currentRow)) if heavy or cuts else F.count(F.lit(1)).over(W.partitionBy(*by, "_range", col))
    light = known.where(~F.col("_heavy")).withColumn("_r", F.rank().over(inside) + (peers - 1) / 2.0).join(offsets, same)
    light = light.withColumn(out, F.col("_o") + F.col("_h") + F.col("_r")).drop("_r")
    full = known.where("_heavy").join(offsets, same).withColumn(out, F.col("_o") + (F.col("_h") + 1) / 2.0)
    ranked = light.unionByName(full)
    if descending:
        ranked = ranked.withColumn(out, F.col("_all") + 1 - F.col(out))
    none = df.where(F.col(col).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.select(*df.columns, F.col(out).cast("double").alias(out)).unionByName(none)


def previous_time(df: DataFrame, key: str = "customer_id", ts: str = "ts",
                  tie: str = "invoice", out: str = "prev_ts") -> DataFrame:
    """Time of the preceding row of the same key, in (ts, tie) order.

    The work is split by key and calendar day, so a key with a very large share of the
    rows is spread over its days; across days only one row per key and day is ordered.
    """
    dated = df.withColumn("_day", F.to_date(ts))
    within = dated.withColumn(
        "_prev", F.lag(ts).over(W.partitionBy(key, "_day").orderBy(ts, tie)))
    days = dated.groupBy(key, "_day").agg(F.max(ts).alias("_last"))
    carried = days.select(
        key, "_day", F.lag("_last").over(W.partitionBy(key).orderBy("_day")).alias("_carry"))
    return (within.join(carried, [key, "_day"], "left")
            .withColumn(out, F.coalesce("_prev", "_carry"))
            .drop("_day", "_prev", "_carry"))


def shuffled(key: str, seed: int) -> Column:
    """A seeded order of keys: their hash, and where hashes are equal a second one."""
    first = F.xxhash64(F.col(key), F.lit(seed)).cast("decimal(20,0)")
    second = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("second")), F.lit(10**17)).cast("decimal(17,0)")
    return (first * F.lit(10**17).cast("decimal(18,0)") + second).cast("decimal(38,0)")


def folds(df: DataFrame, key: str, k: int, how: str = "contiguous", seed: int = 42,
          label: str | None = None) -> DataFrame:
    """Fold number 1..k per key: contiguous, shuffled or stratified.

    Sizes differ by at most one and the first folds take the extra rows. Shuffled folds
    order by a seeded hash, so they do not depend on partitioning.
    """
    by = [label] if how == "stratified" else []
    rows = df.select(key, *by)
    if how == "contiguous":
        order = key
    elif how in ("shuffled", "stratified"):
        rows = rows.withColumn("_h", shuffled(key, seed))
        order = "_h"
    else:
        raise ValueError(how)
    if order == key:
        placed = row_index(rows, key, by).withColumnRenamed("rn", "_rn")
    else:
        index = row_index(rows, "_h", by).withColumnRenamed("rn", "_rn")
        placed = rows.join(index, [*by, "_h"])
    if by:
        total = rows.groupBy(*by).agg(F.count("*").alias("_total"))
        placed = placed.join(total, by)
    else:
        placed = placed.withColumn("_total", rows.agg(F.count("*").alias("n")).scalar())
    size = F.floor(F.col("_total") / k)
    extra = F.col("_total") - size * k
    wide = extra * (size + 1)
    fold = F.when(F.col("_rn") <= wide, F.ceil(F.col("_rn") / (size + 1))).otherwise(
        extra + F.ceil((F.col("_rn") - wide) / F.greatest(size, F.lit(1))))
    return placed.select(key, *by, fold.cast("int").alias("fold"))


def nearest_row(df: DataFrame, col: str, target: Column, keep: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """The row whose value is closest to a target; ties go to the smallest kept columns."""
    best = F.min_by(F.struct(*keep), F.struct(F.abs(F.col(col) - target), *keep))
    return df.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")


def arg_best(df: DataFrame, value: str, keep: Sequence[str], largest: bool = True,
             by: Sequence[str] = ()) -> DataFrame:
    """Row holding the extreme value; ties go to the smallest kept columns."""
    v = -F.col(value) if largest else F.col(value)
    best = F.min_by(F.struct(*keep, value), F.struct(v, *keep))
    return df.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")


def top_n(df: DataFrame, col: str, n: int, key: str, cols: Sequence[str] = ()) -> DataFrame:
    """The n largest rows, ties by key."""
    out = df.orderBy(F.col(col).desc(), F.col(key).asc()).limit(n)
    return out.select(*cols) if cols else out


def topk_overlap(df: DataFrame, a: str, b: str, k: int, key: str) -> DataFrame:
    """How many keys are among the k largest by both columns."""
    both = top_n(df, a, k, key, [key]).intersect(top_n(df, b, k, key, [key]))
    return both.agg(F.count("*").alias("overlap")).select(F.lit(k).cast("long").alias("k"), "overlap")


def interp(df: DataFrame, col: str, xs: Sequence[float], ys: Sequence[float], out: str,
           left: float | None = None, right: float | None = None) -> DataFrame:
    """Piecewise linear lookup of a fitted curve; the ends extend unless values are given.

    The curve is a small fitted object (one point per day at most), passed as literals.
    """
    xs, ys = [float(x) for x in xs], [float(y) for y in ys]
    n = len(xs)
    left = ys[0] if left is None else left
    right = ys[-1] if right is None else right
    placed = with_range(df, col, xs, "_seg")
    k, x = F.col("_seg"), F.col(col).cast("double")
    xa, ya = F.lit(xs), F.lit(ys)
    x0, x1, y0, y1 = F.get(xa, k - 1), F.get(xa, k), F.get(ya, k - 1), F.get(ya, k)
    value = (F.when(x.isNull(), None).when(k == 0, F.lit(left))
             .when((k == n) & (x == xs[-1]), F.lit(ys[-1])).when(k == n, F.lit(right))
             .otherwise(y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)))
    return placed.withColumn(out, value).drop("_seg")


def asof(df: DataFrame, col: str, points: DataFrame, x: str, before: str = "before", after: str = "after") -> DataFrame:
    """Attach the last point at or before ``col`` and the first one after it, as structs of the points' columns.

    Points and rows go into value ranges together and meet in a window inside each range; the last and first
    points of the other ranges, one row per range, are carried over its borders. So both sides may have any size.
    Rows of a value that would fill a range are looked up once for the value. Points must differ in ``x``; null
    points are left out, and rows with a null value find none.
    """
    cuts, heavy = ranges_and_heavy(df.select(F.col(col).cast("double").alias("_x")).unionByName(points.select(F.col(x).cast("double").alias("_x"))), "_x")
    fields = F.struct(*points.columns)
    kind = points.select(fields.alias("p")).schema["p"].dataType
    placed = points.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x"), fields.alias("_p"))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(col).cast("double").alias("_x"))
    row_type = rows.schema["_row"].dataType
    is_heavy = F.coalesce(F.col("_x").isin(heavy), F.lit(False)) if heavy else F.lit(False)
    light = rows.where(F.col("_x").isNotNull() & ~is_heavy)
    asked = light.withColumn("_p", F.lit(None).cast(kind))
    if heavy:
        asked = asked.unionByName(df.sparkSession.createDataFrame([(v,) for v in heavy], "_x double").select(
            F.lit(None).cast(row_type).alias("_row"), "_x", F.lit(None).cast(kind).alias("_p")))
    both = asked.withColumn("_is", F.lit(1)).unionByName(placed.select(F.lit(None).cast(row_type).alias("_row"), "_x", "_p").withColumn("_is", F.lit(0)))
    ranged = with_range(both, "_x", cuts)
    # one row per range
    ends = with_range(placed, "_x", cuts).groupBy("_range").agg(F.min_by("_p", "_x").alias("_low"), F.max_by("_p", "_x").alias("_high"))
    every = df.sparkSession.range(len(cuts) + 2).select(F.col("id").cast("int").alias("_range")).join(ends, "_range", "left")
    w = W.orderBy("_range")
    borders = F.broadcast(every.select("_range", F.last("_high", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_from"),
                                       F.first("_low", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_to")))
    # a point comes before the rows at its own value; both frames run from the range's start, as one to its end is read anew for each row
    inside = W.partitionBy("_range").orderBy("_x", "_is")
    backward = W.partitionBy("_range").orderBy(F.desc("_x"), F.desc("_is"))
    found = (ranged.withColumn(before, F.last("_p", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn(after, F.last("_p", ignorenulls=True).over(backward.rowsBetween(W.unboundedPreceding, -1)))
             .where("_is = 1").join(borders, "_range")
             .select("_row", "_x", F.coalesce(before, "_from").alias(before), F.coalesce(after, "_to").alias(after)))
    out = found
    if heavy:
        near = F.broadcast(found.where("_row IS NULL").select("_x", before, after))
        out = found.where("_row IS NOT NULL").unionByName(rows.where(is_heavy).join(near, "_x").select("_row", "_x", before, after))
    null = rows.where("_x IS NULL").select("_row", "_x", F.lit(None).cast(kind).alias(before), F.lit(None).cast(kind).alias(after))
    return out.unionByName(null).select("_row.*", before, after)


def interp_table(df: DataFrame, col: str, curve: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Piecewise linear lookup in a curve that is a table of any size; the ends extend."""
    met = asof(df, col, curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x", "_b", "_a")
    share = F.try_divide(F.col(col).cast("double") - F.col("_b.x"), F.col("_a.x") - F.col("_b.x"))
    value = F.when(F.col("_b").isNull(), F.col("_a.y")).when(F.col("_a").isNull(), F.col("_b.y")).otherwise(F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * share)
    return met.withColumn(out, value).drop("_a", "_b")


def step(df: DataFrame, col: str, xs: Sequence[float], ys: Sequence[float], out: str,
         before: float = 1.0) -> DataFrame:
    """Value of a fitted step curve at the last point at or before ``col``."""
    placed = with_range(df, col, [float(x) for x in xs], "_seg")
    return placed.withColumn(out, F.coalesce(
        F.get(F.lit([float(y) for y in ys]), F.col("_seg") - 1), F.lit(before))).drop("_seg")
