"""Gap distribution on a daily grid and its elbow.

The gap table is reduced to counts per day first; everything after that works on the
grid, whose size is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.constants import KEY_DAYS, MAX_GAP_DAY


def ecdf(df: DataFrame, col: str = "gap_days", max_day: int = MAX_GAP_DAY) -> DataFrame:
    """Share of values <= d for d = 0..max_day."""
    counts = df.groupBy(F.greatest(F.lit(0), F.least(F.col(col), F.lit(max_day + 1))).cast("long")
                        .alias("day")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    grid = df.sparkSession.range(0, max_day + 1).withColumnRenamed("id", "day")
    filled = grid.join(counts, "day", "left").fillna(0, ["n"])
    running = F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return filled.select(F.col("day").cast("int").alias("day"),
                         (running / total).alias("cdf"))


def key_days(df: DataFrame, col: str = "gap_days", days: Sequence[int] = KEY_DAYS) -> DataFrame:
    """Cumulative percentage at each key day and the gain over the one before."""
    one = df.agg(*[(F.avg((F.col(col) <= d).cast("double")) * 100).alias(f"p{d}") for d in days])
    prev = [0, *days]
    rows = ", ".join(f"{d}, p{d}, p{d} - {f'p{p}' if p else '0D'}" for p, d in zip(prev, days))
    return one.selectExpr(f"stack({len(days)}, {rows}) AS (day, cumulative_pct, gain_pp)")


def marginal(grid: DataFrame, width: int = 5) -> DataFrame:
    """Percentage points gained in each bucket (w, w + width]."""
    ahead = F.lead("cdf", width).over(W.orderBy("day"))
    return (grid.withColumn("_ahead", ahead)
            .where((F.col("day") % width == 0) & F.col("_ahead").isNotNull())
            .select("day", ((F.col("_ahead") - F.col("cdf")) * 100).alias("gain_pp")))


def elbow_chord(grid: DataFrame) -> DataFrame:
    """Day farthest from the chord through the first and last points of the curve."""
    ends = grid.agg(F.struct(
        F.min("day").alias("d0"), F.max("day").alias("d1"),
        F.min_by("cdf", "day").alias("y0"), F.max_by("cdf", "day").alias("y1")).alias("e")).scalar()
    e = {k: F.col(f"_e.{k}") for k in ("d0", "d1", "y0", "y1")}
    span = F.greatest(e["d1"], F.lit(1)).cast("double")
    x, x0, x1 = F.col("day") / span, e["d0"] / span, e["d1"] / span
    dy, dx = e["y1"] - e["y0"], x1 - x0
    dist = F.abs(dy * x - dx * F.col("cdf") + x1 * e["y0"] - e["y1"] * x0) / F.sqrt(dy * dy + dx * dx)
    # rounding keeps float noise from choosing between equal distances
    scored = grid.withColumn("_e", ends).withColumn("dist", F.round(dist, 12))
    return scored.agg(F.min_by(F.struct("day", "cdf", "dist"), F.struct(-F.col("dist"), "day")).alias("b")
                      ).select(F.col("b.day").alias("elbow_day"), (F.col("b.cdf") * 100).alias("elbow_pct"),
                               F.col("b.dist").alias("distance"))


def gaussian(grid: DataFrame, sigma: float = 3.0, truncate: float = 4.0,
             max_day: int = MAX_GAP_DAY) -> DataFrame:
    """Gaussian smoothing of the grid with mirrored edges."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]
    n = max_day + 1
    # each point contributes to the grid positions whose (mirrored) window reaches it
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w"))
                     for o, w in zip(range(-radius, radius + 1), weights)])
    source = (grid.sparkSession.range(0, n).select(F.col("id").cast("int").alias("day"),
                                                    F.explode(taps).alias("t"))
              .select("day", F.col("t.w").alias("w"), (F.col("day") + F.col("t.o")).alias("_s")))
    folded = F.when(F.col("_s") < 0, -F.col("_s") - 1).when(
        F.col("_s") >= n, 2 * n - 1 - F.col("_s")).otherwise(F.col("_s"))
    source = source.withColumn("_s", folded)
    values = grid.select(F.col("day").alias("_s"), "cdf")
    smooth = source.join(values, "_s").groupBy("day").agg(F.sum(F.col("w") * F.col("cdf")).alias("smooth"))
    return grid.join(smooth, "day")


def _slope(col: str, w) -> Column:
    before, after = F.lag(col).over(w), F.lead(col).over(w)
    return (F.when(before.isNull(), after - F.col(col))
            .when(after.isNull(), F.col(col) - before)
            .otherwise((after - before) / 2.0))


def curvature(smoothed: DataFrame) -> DataFrame:
    """|y''| / (1 + y'^2)^1.5 with second-order central differences."""
    w = W.orderBy("day")
    d1 = smoothed.withColumn("dy", _slope("smooth", w))
    d2 = d1.withColumn("ddy", _slope("dy", w))
    return d2.withColumn("curvature", F.abs("ddy") / F.pow(1 + F.col("dy") * F.col("dy"), F.lit(1.5)))


def elbow_curvature(curve: DataFrame, search_start: int = 10) -> DataFrame:
    scored = curve.where(F.col("day") >= search_start).withColumn("_c", F.round("curvature", 12))
    return scored.agg(F.min_by(F.struct("day", "cdf"), F.struct(-F.col("_c"), "day")).alias("b")).select(
        F.col("b.day").alias("curvature_day"), (F.col("b.cdf") * 100).alias("curvature_pct"))


def summary(grid: DataFrame, sigma: float = 3.0, max_day: int = MAX_GAP_DAY) -> DataFrame:
    """Both elbows and the range between them, one row."""
    chord = elbow_chord(grid).withColumn("_k", F.lit(1))
    bend = elbow_curvature(curvature(gaussian(grid, sigma, max_day=max_day))).withColumn("_k", F.lit(1))
    out = chord.join(bend, "_k").drop("_k", "distance")
    return out.withColumns({
        "range_low": F.least("elbow_day", "curvature_day"),
        "range_high": F.greatest("elbow_day", "curvature_day"),
    })
