"""Ranking, classification, regression, agreement and censoring-aware metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.constants import BUCKET_BINS, EVAL_GRID
from tenure.functions.scalars import bin_right_closed, clip
from tenure.operators import survival
from tenure.operators.features import histogram
from tenure.operators.ordered import (
    prefix_sum, quantiles, sketch, topk_overlap, with_range, with_rank,
)
from tenure.operators.report import stack_predictions

KEY = "customer_id"


# Score order --------------------------------------------------------------------


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Running row and positive counts from the highest score down."""
    counts = prefix_sum(df, score, {"n": F.lit(1), "pos": F.col(label).cast("long")}, by=by,
                        descending=True)
    totals = df.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("total"), F.sum(F.col(label).cast("long")).alias("total_pos"))
    if by:
        return counts.join(totals, list(by))
    t = totals.select(F.struct("total", "total_pos").alias("t")).scalar()
    return counts.withColumn("_t", t).select("*", "_t.total", "_t.total_pos").drop("_t")


def roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """False and true positive rate at each distinct threshold."""
    c = score_counts(df, score, label)
    return c.select(
        F.col(score).alias("threshold"),
        ((F.col("cum_n") - F.col("cum_pos")) / (F.col("total") - F.col("total_pos"))).alias("fpr"),
        (F.col("cum_pos") / F.col("total_pos")).alias("tpr"))


def auc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, equal scores counting half."""
    c = score_counts(df, score, label, by)
    neg = F.col("n") - F.col("pos")
    before = F.col("cum_pos") - F.col("pos")
    area = F.sum(neg * (before + F.col("pos") / 2.0))
    return c.groupBy(*by).agg(F.try_divide(
        area, F.max(F.col("total_pos").cast("double") * (F.col("total") - F.col("total_pos")))).alias("auc"))


def pr(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = score_counts(df, score, label)
    return c.select(F.col(score).alias("threshold"),
                    (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                    (F.col("cum_pos") / F.col("total_pos")).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = score_counts(df, score, label)
    return c.agg(F.sum(F.col("pos") / F.col("total_pos") * F.col("cum_pos") / F.col("cum_n"))
                 .alias("average_precision"))


def gains_lift(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Share of rows and of positives reached down to each score, and their ratio."""
    c = score_counts(df, score, label)
    out = c.select(F.col(score).alias("threshold"),
                   (F.col("cum_n") / F.col("total")).alias("share"),
                   (F.col("cum_pos") / F.col("total_pos")).alias("gain"))
    return out.withColumn("lift", F.col("gain") / F.col("share"))


def youden(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the largest TPR - FPR; the highest of equal ones."""
    points = roc(df, score, label).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return points.agg(F.max(F.struct("j", "threshold")).alias("b")).select(
        F.col("b.threshold").alias("threshold"), F.col("b.j").alias("j"))


def classification(df: DataFrame, score: str = "score", label: str = "label",
                   threshold: float | Column = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, Brier score, precision, recall, F1 and accuracy."""
    y = F.col(label) == 1
    p = F.col(score) >= threshold
    one = df.groupBy(*by).agg(
        F.sum((y & p).cast("long")).alias("tp"), F.sum((~y & p).cast("long")).alias("fp"),
        F.sum((y & ~p).cast("long")).alias("fn"), F.sum((~y & ~p).cast("long")).alias("tn"),
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return one.withColumns({
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
        "accuracy": (tp + tn) / (tp + fp + fn + tn)})


def calibration(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin (closed on the right)."""
    names = [f"e{i}" for i in range(1, bins)]
    edges = quantiles(df, score, [i / bins for i in range(1, bins)], names).select(
        F.struct(*names).alias("e")).scalar()
    rows = df.withColumn("_e", edges)
    k = sum(((F.col(score) > F.col(f"_e.{n}")).cast("int") for n in names), F.lit(0))
    return rows.withColumn("bin", k).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed"))


ERRORS = {(1, 1): "True Positive", (0, 0): "True Negative", (1, 0): "False Negative"}


def error_categories(df: DataFrame, score: str, label: str, threshold: float | Column) -> DataFrame:
    y, p = F.col(label) == 1, F.col(score) >= threshold
    return df.withColumn("category", F.when(y & p, "True Positive").when(~y & ~p, "True Negative")
                         .when(y & ~p, "False Negative").otherwise("False Positive"))


def error_profile(categorised: DataFrame, score: str, cols: Sequence[str]) -> DataFrame:
    return categorised.groupBy("category").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), *[F.avg(c).alias(c) for c in cols])


def confident_errors(categorised: DataFrame, score: str, key: str, n: int = 20) -> DataFrame:
    """The n most confident false negatives and false positives."""
    fn = categorised.where("category = 'False Negative'").orderBy(F.col(score).asc(), key).limit(n)
    fp = categorised.where("category = 'False Positive'").orderBy(F.col(score).desc(), key).limit(n)
    return fn.unionByName(fp)


# Regression and agreement --------------------------------------------------------


def _regression_aggs(y: Column, p: Column) -> list[Column]:
    return [F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
            (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
            F.corr(y, p).alias("pearson")]


def regression(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_regression_aggs(F.col(y).cast("double"), F.col(p).cast("double")))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks."""
    both = df.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    ranked = with_rank(with_rank(both, "_a", "_ra", by=by), "_b", "_rb", by=by)
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def ks(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest distance of the distributions of two columns, with its asymptotic p-value."""
    both = df.select(F.explode(F.array(
        F.struct(F.lit(1).alias("ia"), F.lit(0).alias("ib"), F.col(a).cast("double").alias("v")),
        F.struct(F.lit(0).alias("ia"), F.lit(1).alias("ib"), F.col(b).cast("double").alias("v")))).alias("s")
    ).select("s.*").where("v IS NOT NULL")
    c = prefix_sum(both, "v", {"a": F.col("ia"), "b": F.col("ib")})
    n = both.agg(F.struct(F.sum("ia").alias("na"), F.sum("ib").alias("nb")).alias("n")).scalar()
    gap = c.withColumn("_n", n).agg(
        F.max(F.abs(F.col("cum_a") / F.col("_n.na") - F.col("cum_b") / F.col("_n.nb"))).alias("statistic"),
        F.max("_n.na").alias("na"), F.max("_n.nb").alias("nb"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    x = F.col("statistic") * en
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 41)), F.lit(0.0))
    return gap.select("statistic", F.when(x < 0.2, 1.0).otherwise(clip(tail, 0.0, 1.0)).alias("p_value"))


def align(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Inner join two result sets on their key."""
    return a.join(b, key, "inner")


def attach_predictions(df: DataFrame, preds: DataFrame, cols: Sequence[str], key: str = KEY) -> DataFrame:
    return df.join(preds.select(key, *cols), key, "left").fillna(0.0, list(cols))


def agreement(df: DataFrame, a: str, b: str, key: str = KEY, ks_top: Sequence[int] = (50, 100)) -> DataFrame:
    """All agreement figures of two score columns, one row."""
    one = df.agg(F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"),
                 F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias("rmse"),
                 F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.sum(a).alias("total_a"),
                 F.sum(b).alias("total_b"))
    medians = {f"median_{s}": quantiles(df, c, [0.5], ["m"]).scalar() for s, c in (("a", a), ("b", b))}
    dist = ks(df, a, b).select(F.struct("statistic", "p_value").alias("k")).scalar()
    return one.withColumns({
        **medians,
        "spearman": spearman(df, a, b).scalar(),
        "ks_statistic": dist["statistic"], "ks_p_value": dist["p_value"],
        **{f"top{k}_overlap": topk_overlap(df, a, b, k, key).select("overlap").scalar() for k in ks_top}})


def diff_profile(df: DataFrame, a: str, b: str, lo: float, hi: float, bins: int = 50) -> DataFrame:
    """Histogram of the clipped difference b - a."""
    diff = df.select(clip(F.col(b) - F.col(a), lo, hi).alias("diff"))
    return histogram(diff, "diff", bins, lo, hi)


def uncertainty_cv(df: DataFrame, mean: str, std: str) -> DataFrame:
    return df.withColumn("cv", F.col(std) / (F.col(mean) + 1e-6))


def by_bucket(df: DataFrame, cols: Sequence[str], col: str = "frequency") -> DataFrame:
    return df.withColumn("freq_bucket", bin_right_closed(col, *BUCKET_BINS)).groupBy("freq_bucket").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def clv_table(df: DataFrame, actual: str, preds: Mapping[str, str]) -> DataFrame:
    """Per model: regression metrics, errors by outcome and churn detection."""
    long = stack_predictions(df, preds, [actual])
    y, p = F.col(actual).cast("double"), F.col("pred")
    gone = y == 0
    base = long.groupBy("model").agg(
        *_regression_aggs(y, p),
        F.avg(F.when(gone, F.abs(y - p))).alias("mae_churned"),
        F.avg(F.when(gone, p)).alias("mean_pred_churned"),
        F.avg(F.when(y > 0, F.abs(y - p))).alias("mae_returned"),
        (F.avg(F.when(gone, (p < 1).cast("double"))) * 100).alias("churn_detection_pct"))
    rank = spearman(long.withColumnRenamed(actual, "_y"), "_y", "pred", by=["model"])
    return base.join(rank, "model")


def error_spread(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Quartiles of predictions for churned and of errors for returned customers."""
    rows = df.select(
        F.when(F.col(actual) == 0, "churned").otherwise("returned").alias("outcome"),
        F.when(F.col(actual) == 0, F.col(pred)).otherwise(
            clip(F.col(pred) - F.col(actual), -1000.0, 1000.0)).alias("value"))
    return quantiles(rows, "value", [0.25, 0.5, 0.75, 0.95], ["q25", "q50", "q75", "q95"], by=["outcome"])


def feature_distribution(df: DataFrame, cols: Sequence[str], label: str, bins: int = 30,
                         few: int = 5) -> DataFrame:
    """Per label: shares per value for features with few values, else a histogram."""
    out = None
    for c in cols:
        rows = df.select(label, F.col(c).cast("double").alias("_v"))
        # whether there is one value more than a few
        if rows.where("_v IS NOT NULL").select("_v").distinct().limit(few + 1).count() <= few:
            counts = rows.where("_v IS NOT NULL").groupBy(label, F.col("_v").alias("bin")).agg(F.count("*").alias("n"))
        else:
            counts = histogram(rows, "_v", bins, by=[label]).withColumn("bin", F.col("bin").cast("double"))
        share = F.col("n") / F.sum("n").over(W.partitionBy(label))
        one = counts.select(F.lit(c).alias("feature"), label, "bin", "n", share.alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


# Censored outcomes -------------------------------------------------------------------


#: Distinct (risk, time) cells that a task of the concordance counts together, about.
BLOCK_ROWS = 200_000


def _inside_block(r: np.ndarray, u: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Concordant and tied weight of the pairs among some cells.

    Ranks in binary first differ at one bit: per bit, cells that share the leading bits are in one run by falling time.
    """
    k = np.unique(r, return_inverse=True)[1]

    def later(group: np.ndarray, count: np.ndarray, weight: np.ndarray) -> float:
        """Sum of weights times the count at later times of the same group."""
        order = np.lexsort((-u, group))
        g, t, c = group[order], u[order], np.concatenate([[0], np.cumsum(count[order])])
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        new_time = new_group | np.concatenate([[True], t[1:] != t[:-1]])
        at = np.arange(len(g))
        start, same = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_time, at, 0))
        return float(weight[order] @ (c[same] - c[start]))

    concordant = 0.0
    for bit in range(int(k.max()).bit_length()):
        one = (k >> bit) & 1 == 1
        concordant += later(k >> (bit + 1), np.where(one, 0, n), np.where(one, w, 0.0))
    return concordant, later(k, n, w)


def cindex(df: DataFrame, risk: str = "risk", duration: str = "duration", event: str = "event_observed",
           weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Concordance of a risk score with the order of events.

    A pair counts when the event of i comes before j's time, or at it with j censored; it
    is concordant when i has the higher risk, and half when risks are equal.
    Pairs are never listed. Risks are cut into blocks: pairs of different blocks are counted on the histogram of
    (block, time), pairs of one block in the task that has the block's cells, so a row is used twice.
    """
    by = list(by)
    u = F.col(duration).cast("long") * 2 + (1 - F.col(event).cast("int"))
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, u.alias("_u"), F.col(risk).cast("double").alias("_r"),
                     F.when(F.col(event) == 1, w).otherwise(0.0).cast("double").alias("_w")).where("_r IS NOT NULL")
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    cuts = sketch(rows, "_r", blocks)[0] if blocks > 1 else []
    cells = with_range(rows.groupBy(*by, "_r", "_u").agg(F.count("*").alias("_n"), F.sum("_w").alias("_w")), "_r", cuts, "_k")
    coarse = _block_pairs(cells.groupBy(*by, "_k", "_u").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w")), by, len(cuts) + 2)
    names = [f"_by{i}" for i in range(len(by))]
    kinds = "".join(f"{n} {rows.schema[c].dataType.simpleString()}, " for n, c in zip(names, by))

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = _inside_block(*(pdf[c].to_numpy() for c in ("_r", "_u", "_n", "_w")))
        return pd.DataFrame({n: pd.Series([k], dtype=object) for n, k in zip(names, key)} | {"_c": [got[0]], "_t": [got[1]]})

    fine = cells.groupBy(*by, "_k").applyInPandas(inside, f"{kinds}_c double, _t double").groupBy(*names).agg(F.sum("_c").alias("_c"), F.sum("_t").alias("_t"))
    if by:
        same = None
        for n, c in zip(names, by):
            one = F.col(c).eqNullSafe(F.col(n))
            same = one if same is None else same & one
        both = coarse.join(fine, same)
    else:
        # one row each
        both = coarse.withColumn("_f", fine.select(F.struct("_c", "_t")).scalar()).select("*", "_f.*")
    out = both.select(*by, (F.col("concordant") + F.coalesce("_c", F.lit(0.0))).alias("concordant"), F.coalesce("_t", F.lit(0.0)).alias("tied"), "comparable")
    return out.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable")))


def _block_pairs(cells: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """Concordant pairs of different blocks, and all comparable pairs, from the histogram of (block, time).

    With the block's number in binary, two blocks first differ at one bit, so per bit the cells sharing
    the leading bits are reduced to counts per time and summed from the latest time back.
    """
    bits = max(1, blocks.bit_length())
    level = F.col("_b")
    marked = cells.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    bit = F.expr("shiftright(_k, _b) & 1")
    spread = marked.select(
        *by, "_b", "_u",
        F.when(level == bits, 0).otherwise(F.expr("shiftright(_k, _b + 1)")).alias("_p"),
        F.when((level == bits) | (bit == 0), F.col("_n")).otherwise(0).alias("_n"),
        F.when((level == bits) | (bit == 1), F.col("_w")).otherwise(0.0).alias("_w"))
    per_time = spread.groupBy(*by, "_b", "_p", "_u").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))
    later = W.partitionBy(*by, "_b", "_p").orderBy(F.col("_u").desc()).rowsBetween(W.unboundedPreceding, -1)
    pairs = per_time.withColumn("_pairs", F.col("_w") * F.coalesce(F.sum("_n").over(later), F.lit(0)))
    # censored rows carry no event weight, so only events open a pair
    return pairs.groupBy(*by).agg(
        F.sum(F.when(level < bits, F.col("_pairs")).otherwise(0.0)).alias("concordant"),
        F.sum(F.when(level == bits, F.col("_pairs")).otherwise(0.0)).alias("comparable"))


def eval_times(df: DataFrame, grid: tuple[int, int, int] = EVAL_GRID, duration: str = "duration",
               event: str = "event_observed") -> DataFrame:
    """Grid days within the 5-95 % range of event times."""
    span = quantiles(df.where(F.col(event) == 1), duration, [0.05, 0.95], ["lo", "hi"]).select(
        F.struct("lo", "hi").alias("s")).scalar()
    days = df.sparkSession.range(*grid).select(F.col("id").cast("int").alias("t"))
    return days.where((F.col("t") >= span["lo"]) & (F.col("t") <= span["hi"]))


def censor_curve(train: DataFrame, duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Kaplan-Meier curve of the censoring times."""
    flipped = train.select(duration, (1 - F.col(event)).alias(event))
    return survival.km(flipped, duration=duration, event=event)


def with_censor_weight(train: DataFrame, test: DataFrame, duration: str = "duration",
                       event: str = "event_observed", out: str = "g") -> DataFrame:
    """Attach the censoring curve's value at each row's own time.

    The lookup table has one row per distinct day, filled forward, and joins on equality.
    """
    curve = censor_curve(train, duration, event).select(F.col("t").alias(duration), F.col("s").alias("_s"))
    days = test.select(duration).distinct()
    filled = days.join(curve, duration, "full").withColumn(out, F.coalesce(
        F.last("_s", ignorenulls=True).over(W.orderBy(duration).rowsBetween(W.unboundedPreceding, 0)),
        F.lit(1.0)))
    return test.join(filled.select(duration, out), duration)


def cindex_ipcw(train: DataFrame, test: DataFrame, risk: str = "risk", duration: str = "duration",
                event: str = "event_observed", by: Sequence[str] = ()) -> DataFrame:
    """Concordance with pairs weighted by the inverse squared censoring probability."""
    weighted = with_censor_weight(train, test, duration, event)
    weighted = weighted.withColumn("_ipcw", F.coalesce(F.try_divide(F.lit(1.0), F.col("g") * F.col("g")), F.lit(0.0)))
    return cindex(weighted, risk, duration, event, "_ipcw", by)


def td_auc(train: DataFrame, test: DataFrame, times: Sequence[int], risk: str = "risk",
           duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Cumulative/dynamic AUC per time; all times share one pass over the risk order."""
    weighted = with_censor_weight(train, test, duration, event)
    w = F.coalesce(F.try_divide(F.lit(1.0), F.col("g")), F.lit(0.0))
    vals: dict[str, Column] = {}
    for i, t in enumerate(times):
        vals[f"c{i}"] = F.when((F.col(event) == 1) & (F.col(duration) <= t), w).otherwise(0.0)
        vals[f"m{i}"] = F.when(F.col(duration) > t, 1.0).otherwise(0.0)
    run = prefix_sum(weighted.withColumn("_r", F.col(risk).cast("double")), "_r", vals)
    aggs = []
    for i in range(len(times)):
        c, m, cum = F.col(f"c{i}"), F.col(f"m{i}"), F.col(f"cum_m{i}")
        aggs.append(F.try_divide(F.sum(c * (cum - m / 2)), F.sum(c) * F.sum(m)).alias(f"a{i}"))
    rows = ", ".join(f"{t}, a{i}" for i, t in enumerate(times))
    return run.agg(*aggs).selectExpr(f"stack({len(times)}, {rows}) AS (t, auc)")


def mean_td_auc(aucs: DataFrame, test: DataFrame, duration: str = "duration",
                event: str = "event_observed") -> DataFrame:
    """Mean AUC over the times, weighted by the drop of the survival curve."""
    times = sorted(r.t for r in aucs.select("t").collect())
    curve = survival.step_at(survival.km(test, duration=duration, event=event), times)
    rows = ", ".join(f"{t}, `s_{t}`" for t in times)
    s = curve.selectExpr(f"stack({len(times)}, {rows}) AS (t, s)")
    w = W.orderBy("t")
    drops = s.withColumn("d", F.coalesce(F.lag("s").over(w), F.lit(1.0)) - F.col("s"))
    return aucs.join(drops, "t").agg(
        F.try_divide(F.sum(F.col("auc") * F.col("d")), F.sum(F.when(F.col("auc").isNotNull(), F.col("d")))).alias("mean_auc"))


def brier(train: DataFrame, test: DataFrame, times: Sequence[int], prefix: str = "s_",
          duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Censoring-weighted squared error of S(t), from columns ``s_<t>``, per time."""
    curve = censor_curve(train, duration, event)
    g_at = survival.step_at(curve, times, names=[f"g{t}" for t in times]).select(
        F.struct(*[f"g{t}" for t in times]).alias("g")).scalar()
    rows = with_censor_weight(train, test, duration, event).withColumn("_g", g_at)
    aggs = []
    for t in times:
        s = F.col(f"{prefix}{t}")
        died = (F.col(duration) <= t) & (F.col(event) == 1)
        err = (F.when(died, F.coalesce(F.try_divide(s * s, F.col("g")), F.lit(0.0)))
               .when(F.col(duration) > t, F.coalesce(F.try_divide((1 - s) * (1 - s), F.col(f"_g.g{t}")), F.lit(0.0)))
               .otherwise(0.0))
        aggs.append(F.avg(err).alias(f"b{t}"))
    stacked = ", ".join(f"{t}, b{t}" for t in times)
    return rows.agg(*aggs).selectExpr(f"stack({len(times)}, {stacked}) AS (t, brier)")


def ibs(scores: DataFrame) -> DataFrame:
    """Trapezoid mean of the Brier score over its time range (one row per grid time)."""
    w = W.orderBy("t")
    steps = scores.withColumns({"_t": F.lead("t").over(w), "_b": F.lead("brier").over(w)})
    area = F.sum((F.col("_t") - F.col("t")) * (F.col("_b") + F.col("brier")) / 2.0)
    return steps.agg(F.try_divide(area, F.max("t") - F.min("t")).alias("ibs"))
