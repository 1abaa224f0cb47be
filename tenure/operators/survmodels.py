"""Discrete-time forest, boosted Cox trees and accelerated failure time models."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tenure.functions.scalars import clip, norm_cdf
from tenure.operators import metrics, ordered, trees as task_trees
from tenure.operators.ordered import quantiles
from tenure.session import checkpointed

KEY = "customer_id"


def _assemble(df: DataFrame, cols: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


# Forest ---------------------------------------------------------------------------


def person_periods(df: DataFrame, width: int, duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """One row per customer and period at risk; the event marks its last period."""
    last = F.floor(F.col(duration) / width).cast("int")
    rows = df.withColumn("_last", last).withColumn("period", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    return rows.withColumn("_y", F.when((F.col("period") == F.col("_last")) & (F.col(event) == 1), 1.0).otherwise(0.0)).drop("_last")


#: Customer periods that a task of a fit has: from so many on it takes work away from others, and at most about so many.
TASK_PERIODS = (20_000, 1_000_000)


def spread(df: DataFrame, periods: int) -> DataFrame:
    """Deal customers to as many tasks as their periods need, as a small table of customers may come as one partition.

    A task sends sums for all nodes of all trees, so there are no more tasks than the cluster runs at once unless they were too large.
    """
    least, most = TASK_PERIODS
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, periods // least), math.ceil(periods / most))
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


@dataclass
class Forest:
    model: object
    cols: tuple[str, ...]
    width: int
    periods: int


def fit_forest(df: DataFrame, cols: Sequence[str], trees: int = 200, depth: int = 8, leaf: int = 10, width: int = 30,
               seed: int = 42, duration: str = "duration", event: str = "event_observed", key: str = KEY) -> Forest:
    """Random forest for the chance of the event in a period, given survival to it.

    Customers that fit a task are sent whole to the tasks, and the sums of spans of their periods make the trees there; customer
    periods are listed for MLlib beyond that only.
    """
    last = F.floor(F.col(duration) / width)
    least, most, total, n = df.agg(F.min(last), F.max(last), F.sum(F.greatest(last, F.lit(0)) + 1), F.count("*")).first()
    rows, periods = person_periods(spread(df, total), width, duration, event), int(most) + 1
    if least >= 0 and total <= task_trees.TASK_PERIODS and n * (len(cols) + 3) <= task_trees.TASK_VALUES:
        model = task_trees.fit_period_forest(df.where(last.isNotNull()), cols, last, F.coalesce(F.col(event) == 1, F.lit(False)), key, trees, depth, leaf, seed)
        return Forest(model, tuple(cols), width, periods)
    model = RandomForestClassifier(
        featuresCol="_features", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed,
        probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
    ).fit(_assemble(rows, [*cols, "period"]))
    return Forest(model, tuple(cols), width, periods)


def forest_curves(df: DataFrame, forest: Forest, times: Sequence[int], prefix: str = "s_") -> DataFrame:
    """S(t) columns and the risk (total cumulative hazard) per customer.

    A customer's rows, one for each period, leave the explode side by side in the task that has the customer, and are folded
    there: nothing is shuffled, grouped or joined back. The customer's own columns travel with the first period only.
    """
    periods, width = forest.periods, forest.width
    grid = df.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(forest.cols)]).withColumn(
        "_period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    scored = forest.model.transform(_assemble(grid, [*[f"_x{i}" for i in range(len(forest.cols))], "_period"]))
    h = F.least(vector_to_array("_prob")[1], F.lit(1 - 1e-9))
    logs = scored.select(F.when(F.col("_period") == 0, F.col("_row")).alias("_row"), F.log1p(-h).alias("_l"))
    # days 0..t have passed: whole periods count in full, the one that is running by its share
    at = np.arange(periods)
    shares = [np.clip((t + 1) / width - at, 0.0, 1.0) for t in times]
    # a period's hazard enters the cumulative hazard of all periods from it on
    weights = np.column_stack([-(periods - at).astype(float), *shares])
    names = [*df.columns, "risk", *[f"{prefix}{t}" for t in times]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            n = rows.num_rows // periods
            left = rows.slice(n * periods)
            if n:
                full = rows.slice(0, n * periods)
                sums = full["_l"].to_numpy().reshape(n, periods) @ weights
                own = full["_row"].combine_chunks().take(pa.array(np.arange(n) * periods)).flatten()
                yield pa.RecordBatch.from_arrays([*own, pa.array(sums[:, 0]), *[pa.array(np.exp(c)) for c in sums[:, 1:].T]], names=names)

    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names[len(df.columns):]]])
    return logs.mapInArrow(fold, schema)


def tune_forest(df: DataFrame, cols: Sequence[str], grid: Sequence[tuple[int, int, int]], folds: int = 3, key: str = KEY,
                width: int = 30, seed: int = 42) -> tuple[tuple[int, int, int], list[tuple]]:
    """Mean held-out concordance of each (trees, depth, leaf); the best and the table."""
    assigned = df.join(ordered.folds(df, key, folds, "shuffled", seed).withColumnRenamed("fold", "_fold"), key).persist()
    table = []
    try:
        for trees, depth, leaf in grid:
            scored = None
            for k in range(1, folds + 1):
                fit = fit_forest(assigned.where(F.col("_fold") != k), cols, trees, depth, leaf, width, seed)
                part = forest_curves(assigned.where(F.col("_fold") == k), fit, [])
                scored = part if scored is None else scored.unionByName(part)
            c = metrics.cindex(scored, by=["_fold"]).agg(F.avg("c_index")).first()[0]
            table.append((trees, depth, leaf, float(c)))
    finally:
        assigned.unpersist()
    best = max(table, key=lambda r: (round(r[3], 10), -r[0], -r[1]))
    return best[:3], table


# Boosting ----------------------------------------------------------------------------


@dataclass
class BoostedCox:
    cols: tuple[str, ...]
    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    h0: list[float] = field(default_factory=list)


def _day_hazard(rows: DataFrame, score: Column, duration: str, event: str) -> DataFrame:
    """(_day, _H): the accumulated Breslow hazard at a score, one row per distinct day."""
    sums = rows.groupBy(F.col(duration).alias("t")).agg(F.sum(F.col(event).cast("double")).alias("d"), F.sum(F.exp(score)).alias("w"))
    days = sorted((r.t, r.d, r.w) for r in sums.collect())
    if not days:
        raise ValueError("no rows")
    t, d, w = zip(*days)
    total = np.cumsum(np.array(d) / np.cumsum(np.array(w)[::-1])[::-1])
    return rows.sparkSession.createDataFrame([(a, float(b)) for a, b in zip(t, total)], StructType(
        [StructField("_day", rows.schema[duration].dataType), StructField("_H", DoubleType())]))


def fit_boosted_cox(df: DataFrame, cols: Sequence[str], rounds: int = 300, rate: float = 0.1, depth: int = 3,
                    subsample: float = 0.8, dropout: float = 0.1, seed: int = 42, key: str = KEY,
                    duration: str = "duration", event: str = "event_observed", cut: int = 20) -> BoostedCox:
    """Trees fitted to the Cox gradient, with row subsampling and tree dropout.

    A round needs the outcome of the one before, so rounds are not shared out: rows that fit a task are fitted in one. For
    more, rows and the outputs of the trees so far are one persisted block; a round reads it for the day sums, for the tree and
    for the next block, which replaces it. So jobs and scans per round do not grow with the round. Weights live on the
    driver: dropping and rescaling trees needs no pass. Lineage is cut every ``cut`` rounds.
    """
    rng = random.Random(seed)
    model = BoostedCox(tuple(cols))
    if 0 < df.count() * (len(cols) + 3) <= task_trees.TASK_VALUES:
        return _boosted_in_a_task(df, model, rounds, rate, depth, subsample, dropout, seed, key, duration, event)
    rows = _assemble(df.select(key, duration, event, *cols), cols).drop(*[c for c in cols if c not in (key, duration, event)])
    rows = rows.withColumn("_out", F.array().cast("array<double>")).persist()
    for i in range(rounds):
        dropped = [k for k in range(len(model.trees)) if rng.random() < dropout]
        weights = [0.0 if k in dropped else w for k, w in enumerate(model.weights)]
        score = _weighted(weights)
        hazard = F.broadcast(_day_hazard(rows, score, duration, event))
        sample = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + i)), F.lit(10_000)) < int(subsample * 10_000))
        # event minus accumulated hazard, the negative gradient of the Cox loss
        grads = sample.join(hazard, F.col(duration) == F.col("_day")).select("_features", (F.col(event) - F.exp(score) * F.col("_H")).alias("_grad"))
        tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_grad", maxDepth=depth, seed=seed,
                                     predictionCol="_tree").fit(grads)
        share = 1.0 / (len(dropped) + 1)
        for k in dropped:
            model.weights[k] *= len(dropped) * share
        model.trees.append(tree)
        model.weights.append(rate * share if dropped else rate)
        grown = tree.transform(rows).withColumn("_out", F.concat("_out", F.array("_tree"))).drop("_tree")
        grown = (checkpointed(grown) if (i + 1) % cut == 0 else grown).persist()
        grown.count()
        rows.unpersist()
        rows = grown
    days = _day_hazard(rows, _weighted(model.weights), duration, event).collect()
    rows.unpersist()
    model.times, model.h0 = [float(r[0]) for r in days], [r[1] for r in days]
    return model


def _boosted_in_a_task(df: DataFrame, model: BoostedCox, rounds: int, rate: float, depth: int, subsample: float, dropout: float,
                       seed: int, key: str, duration: str, event: str) -> BoostedCox:
    cols = model.cols

    def run(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([(c, "ascending") for c in table.column_names])
        x, t, d = task_trees.matrix(table, cols), table["_t"].to_numpy(), table["_d"].to_numpy()
        trees, weights, days, h0 = task_trees.boosted_cox(x, t, d, rounds, rate, depth, subsample, dropout, seed)
        for i, tree in enumerate(trees):
            yield task_trees.packed(i, tree)
        # weights and the hazard by day come as one more tree's arrays
        yield task_trees.packed(-1, task_trees.Tree(np.zeros(0), days, np.zeros(0), h0, weights))

    rows = df.select(F.col(key).alias("_key"), F.col(duration).cast("double").alias("_t"), F.col(event).cast("double").alias("_d"), *cols)
    found = {r.tree: task_trees.unpacked(r) for r in task_trees.everywhere(rows, 1, run, task_trees.SCHEMA).collect()}
    fit = found.pop(-1)
    model.trees, model.weights = [found[i] for i in range(rounds)], fit.gains.tolist()
    model.times, model.h0 = fit.cut.tolist(), fit.value.tolist()
    return model


def _weighted(weights: Sequence[float]) -> Column:
    if not weights:
        return F.lit(0.0)
    return F.aggregate(F.zip_with("_out", F.lit([float(w) for w in weights]), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)


def boosted_scores(df: DataFrame, model: BoostedCox, out: str = "risk") -> DataFrame:
    if model.trees and isinstance(model.trees[0], task_trees.Tree):
        return df.withColumn(out, task_trees.tree_sum(model.trees, model.weights, F.array(*[F.col(c).cast("double") for c in model.cols])))
    scored = _assemble(df, model.cols)
    total = F.lit(0.0)
    for i, (tree, w) in enumerate(zip(model.trees, model.weights)):
        scored = tree.setPredictionCol(f"_t{i}").transform(scored)
        total = total + F.col(f"_t{i}") * w
    return scored.withColumn(out, total).drop("_features", *[f"_t{i}" for i in range(len(model.trees))])


def boosted_curves(df: DataFrame, model: BoostedCox, times: Sequence[int], prefix: str = "s_") -> DataFrame:
    scored = boosted_scores(df, model)

    def h0(t):
        k = int(np.searchsorted(model.times, t, side="right"))
        return model.h0[k - 1] if k else 0.0

    return scored.withColumns({f"{prefix}{t}": F.exp(-F.exp("risk") * h0(t)) for t in times})


# Accelerated failure time --------------------------------------------------------------


def fit_aft(df: DataFrame, cols: Sequence[str], duration: str = "duration", event: str = "event_observed"):
    """Weibull regression on log duration with right censoring."""
    rows = _assemble(df, cols).withColumns({"_t": F.col(duration).cast("double"), "_c": F.col(event).cast("double")})
    return AFTSurvivalRegression(featuresCol="_features", labelCol="_t", censorCol="_c", predictionCol="_scale", maxIter=100).fit(rows)


def aft_scores(df: DataFrame, model, cols: Sequence[str], out: str = "mu") -> DataFrame:
    """Predicted log duration; its negative is the risk."""
    scored = model.transform(_assemble(df, cols))
    return scored.withColumn(out, F.log("_scale")).withColumn("risk", -F.col(out)).drop("_features", "_scale")


def weibull_curves(df: DataFrame, scale: float, times: Sequence[int], mu: str = "mu", prefix: str = "s_") -> DataFrame:
    """S(t) of the fitted Weibull model: its own log scale per row and its own shape."""
    return df.withColumns({f"{prefix}{t}": F.exp(-F.exp((math.log(t) - F.col(mu)) / scale)) for t in times})


def lognormal_sigma(df: DataFrame, mu: str = "mu", duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Population deviation of the log residuals of observed events."""
    return df.where(F.col(event) == 1).agg(F.stddev_pop(F.log(duration) - F.col(mu)).alias("sigma"))


def lognormal_curves(df: DataFrame, sigma: Column, times: Sequence[int], mu: str = "mu", prefix: str = "s_") -> DataFrame:
    staged = df.withColumn("_sigma", sigma)
    return staged.withColumns({f"{prefix}{t}": clip(
        1.0 - norm_cdf((math.log(t) - F.col(mu)) / F.col("_sigma")), 1e-10, 1.0) for t in times}).drop("_sigma")


# Importance and samples ------------------------------------------------------------------


def with_place(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows with the position ``rn`` of their key in key order."""
    return df.join(ordered.row_index(df.select(key), key), key)


def with_donors(df: DataFrame, cols: Sequence[str], key: str = KEY, seed: int = 0, placed: DataFrame | None = None) -> DataFrame:
    """Give every row the values of another row, drawn by a seeded permutation, as the struct ``_donor``.

    ``placed`` is ``with_place(df)``, for callers that draw several permutations of the same rows.
    """
    hashed = df.withColumn("_h", ordered.shuffled(key, seed))
    order = ordered.row_index(hashed.select("_h"), "_h")
    donors = hashed.select("_h", F.struct(*cols).alias("_donor")).join(order, "_h").select("rn", "_donor")
    return (with_place(df, key) if placed is None else placed).join(donors, "rn").drop("rn")


def permuted(df: DataFrame, col: str, key: str = KEY, seed: int = 0) -> DataFrame:
    """Replace a column by its values in a seeded random order of the rows."""
    return with_donors(df, [col], key, seed).withColumn(col, F.col(f"_donor.{col}")).drop("_donor")


def permutation_importance(df: DataFrame, cols: Sequence[str], score, repeats: int = 15, seed: int = 42, key: str = KEY) -> DataFrame:
    """Fall of the concordance when a feature's values are shuffled; mean and deviation.

    ``score`` adds the column ``risk``. A repeat draws one permutation for all features, so it
    costs one join; all shuffles are scored and ranked in one job.
    """
    rows = df.select(key, "duration", "event_observed", *cols)
    placed = checkpointed(with_place(rows, key))
    stacked = rows.withColumns({"feature": F.lit(""), "repeat": F.lit(0)})
    for r in range(repeats):
        pairs = with_donors(rows, cols, key, seed * 1000 + r, placed).withColumn("feature", F.explode(F.array(*[F.lit(c) for c in cols])))
        mixed = pairs.withColumns({c: F.when(F.col("feature") == c, F.col(f"_donor.{c}")).otherwise(F.col(c)) for c in cols})
        stacked = stacked.unionByName(mixed.drop("_donor").withColumn("repeat", F.lit(r)))
    scored = checkpointed(score(stacked).select("duration", "event_observed", "risk", "feature", "repeat"))
    cs = checkpointed(metrics.cindex(scored, by=["feature", "repeat"]).select("feature", "repeat", "c_index"))
    whole = cs.where("feature = ''").select("c_index").scalar()
    drops = cs.where("feature <> ''").withColumn("drop", whole - F.col("c_index"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def sample_customers(df: DataFrame, percents: Sequence[int] = (10, 35, 65, 90), risk: str = "risk", key: str = KEY) -> DataFrame:
    """The customers nearest to percentiles of the risk."""
    names = [f"q{p}" for p in percents]
    targets = quantiles(df, risk, [p / 100 for p in percents], names).select(F.struct(*names).alias("q")).scalar()
    staged = df.withColumn("_q", targets)
    picks = staged.agg(*[F.min_by(key, F.struct(F.abs(F.col(risk) - F.col(f"_q.{n}")), F.col(key))).alias(n) for n in names])
    rows = ", ".join(f"{p}, q{p}" for p in percents)
    chosen = picks.selectExpr(f"stack({len(percents)}, {rows}) AS (percentile, {key})")
    return df.join(chosen, key)


def median_customers(df: DataFrame, by: str = "segment", risk: str = "risk", key: str = KEY) -> DataFrame:
    """The customer nearest to each segment's median risk."""
    mid = quantiles(df, risk, [0.5], ["_m"], by=[by])
    picks = ordered.nearest_row(df.join(mid, by), risk, F.col("_m"), [key], by=[by])
    return df.join(picks.select(key), key, "left_semi")
