import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenure.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One value and one key hold a third of the rows."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", 7.0 if i % 3 == 0 else rng.gauss(0, 5), rng.randrange(2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key string, v double, y int").cache()


def test_prefix_sum_matches_plain_cumsum(skewed):
    got = ordered.prefix_sum(skewed, "v", {"n": F.lit(1), "y": F.col("y")}).toPandas().sort_values("v")
    want = skewed.toPandas().groupby("v").agg(n=("y", "size"), y=("y", "sum")).cumsum()
    assert np.array_equal(got["cum_n"], want["n"]) and np.array_equal(got["cum_y"], want["y"])


def test_prefix_sum_descending_by_group(skewed):
    got = ordered.prefix_sum(skewed, "v", {"n": F.lit(1)}, by=["y"], descending=True).toPandas()
    for y, part in skewed.toPandas().groupby("y"):
        want = part.groupby("v").size().sort_index(ascending=False).cumsum()
        mine = got[got.y == y].set_index("v").sort_index(ascending=False)["cum_n"]
        assert np.array_equal(mine, want)


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_quantiles_do_not_depend_on_partitioning(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        row = ordered.quantiles(skewed, "v", [0.0, 0.25, 0.5, 0.999, 1.0], list("abcde")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert list(row) == pytest.approx(np.quantile(skewed.toPandas()["v"], [0, 0.25, 0.5, 0.999, 1]))


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 50)], "v double")
    assert ordered.quantiles(df, "v", [0.9], ["q"]).first().q == pytest.approx(34)


def test_grouped_quantiles(skewed):
    got = {r.y: r.q for r in ordered.quantiles(skewed, "v", [0.3], ["q"], by=["y"]).collect()}
    want = skewed.toPandas().groupby("y")["v"].quantile(0.3)
    assert got == pytest.approx(want.to_dict())


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3)], "v int")
    got = sorted(r.r for r in ordered.with_rank(df, "v", "r").collect())
    assert got == [1, 2.5, 2.5, 4]


def test_previous_time_hot_key_and_ties(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{i % 50}"
        rows.append((key, f"{i:04d}", datetime(2020, 1, 1) + timedelta(hours=rng.randrange(400))))
    df = spark.createDataFrame(rows, "customer_id string, invoice string, ts timestamp")
    got = ordered.previous_time(df).toPandas().set_index("invoice")["prev_ts"].sort_index()
    pdf = pd.DataFrame(rows, columns=["c", "invoice", "ts"]).sort_values(["c", "ts", "invoice"])
    want = pdf.assign(p=pdf.groupby("c")["ts"].shift(1)).set_index("invoice")["p"].sort_index()
    assert (got.isna() == want.isna()).all() and (got.dropna() == want.dropna()).all()


def test_contiguous_folds_sizes(spark):
    df = spark.range(13).withColumnRenamed("id", "customer_id")
    got = ordered.folds(df, "customer_id", 5).groupBy("fold").count().toPandas().sort_values("fold")
    assert list(got["count"]) == [3, 3, 3, 2, 2]


def test_stratified_folds_balance_labels(skewed):
    got = ordered.folds(skewed, "id", 5, "stratified", label="y").groupBy("y", "fold").count().toPandas()
    assert (got.groupby("y")["count"].max() - got.groupby("y")["count"].min() <= 1).all()
    assert got["count"].sum() == 3000


def test_interp_and_step(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (3.0,), (9.0,)], "x double")
    got = [r.y for r in ordered.interp(df, "x", [1, 2, 3], [10, 20, 40], "y").orderBy("x").collect()]
    assert got == [10, 10, 15, 40, 40]
    got = [r.y for r in ordered.step(df, "x", [1, 2, 3], [0.9, 0.5, 0.1], "y").orderBy("x").collect()]
    assert got == [1.0, 0.9, 0.9, 0.1, 0.1]


def test_topk_overlap(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(10)], "customer_id int, a double, b double")
    assert ordered.topk_overlap(df, "a", "b", 6, "customer_id").first().overlap == 2


def test_equal_hashes_do_not_share_a_place(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tenure.operators import survmodels

    real = F.xxhash64
    # the first hash of every key is the same; only the second tells keys apart
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) if len(c) > 2 else real(c[0]) * 0 + 7)
    df = spark.range(60).selectExpr("id AS customer_id", "id AS v")
    sizes = [r["count"] for r in ordered.folds(df, "customer_id", 4, "shuffled").groupBy("fold").count().collect()]
    assert sorted(sizes) == [15, 15, 15, 15]
    mixed = survmodels.permuted(df, "v")
    assert sorted(r.v for r in mixed.collect()) == list(range(60))


def exchanges_keyed_by(df, *cols):
    """Whether a shuffle of the plan is keyed by one of the columns alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if any(f"hashpartitioning({c}#" in line for c in cols)]


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_a_value_most_rows_share(spark, descending):
    rng = random.Random(8)
    values = [0] * 9000 + [rng.randrange(-500, 500) for _ in range(1000)] + [None] * 5
    df = spark.createDataFrame([(i, v, f"x{i}") for i, v in enumerate(values)], "id int, v long, kept string").repartition(6)
    out = ordered.with_rank(df, "v", "r", descending)
    got = out.toPandas().set_index("id").sort_index()
    want = pd.Series(values, dtype="float").rank(ascending=not descending)
    assert list(out.columns) == ["id", "v", "kept", "r"] and len(got) == len(values)
    assert (got["r"].isna() == want.isna()).all() and np.allclose(got["r"].dropna(), want.dropna())
    assert not exchanges_keyed_by(out, "v")
    # rows of the hot value stay where they are; the others are ranked in ranges of bounded size
    cuts, heavy = ordered.ranges_and_heavy(df, "v")
    assert heavy == [0.0]
    light = ordered.with_range(df.where("v IS NOT NULL AND v <> 0"), "v", cuts).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert light <= 1000


def test_ranks_by_group_and_of_other_types(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), float(rng.choice([0, 0, 0, rng.random()])), str(rng.randrange(1000)) + ".5") for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, v double, d string").selectExpr("g", "v", "cast(d as decimal(20,2)) AS d")
    pdf = df.toPandas()
    got = ordered.with_rank(df, "v", "r", by=["g"]).toPandas()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank())
    assert sorted(map(tuple, got[["g", "v", "r"]].values)) == sorted(map(tuple, want[["g", "v", "r"]].values))
    assert sorted(ordered.with_rank(df, "d", "r").toPandas()["r"]) == sorted(pdf["d"].astype(float).rank())
    assert ordered.with_rank(df.limit(0), "v", "r").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_asof_finds_the_points_beside_a_row(spark, hot):
    rng = random.Random(4)
    values = ([50.0] * 3000 if hot else []) + [rng.uniform(-10, 120) for _ in range(400)] + [10.0, 90.0, None]
    xs = sorted({round(rng.uniform(0, 100), 1) for _ in range(60)} | {10.0, 90.0})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, q double").repartition(5)
    points = spark.createDataFrame([(x, x * x, "p") for x in xs], "x double, y double, name string").repartition(3)
    out = ordered.asof(df, "q", points, "x")
    got = {r.id: (r.q, r.before and r.before.x, r.after and r.after.x) for r in out.collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        low = max((x for x in xs if v is not None and x <= v), default=None)
        high = min((x for x in xs if v is not None and x > v), default=None)
        assert got[i] == (v, low, high)
    curve = ordered.interp_table(df, "q", points, "x", "y", "z").where("q IS NOT NULL").toPandas()
    assert np.allclose(curve["z"], np.interp(curve["q"], xs, [x * x for x in xs]))


def test_asof_without_points_or_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, q double")
    none = spark.createDataFrame([], "x double, y double")
    assert [(r.before, r.after) for r in ordered.asof(df, "q", none, "x").collect()] == [(None, None)] * 2
    assert ordered.asof(df.limit(0), "q", none, "x").collect() == []


def test_asof_reads_no_range_anew_for_each_row(spark):
    df = spark.range(50).selectExpr("id", "id * 0.5 AS q")
    plan = ordered.asof(df, "q", spark.range(20).selectExpr("id * 1.0D AS x"), "x")._jdf.queryExecution().optimizedPlan().toString()
    ranged = [line for line in plan.splitlines() if "Window [" in line and "_x#" in line]
    assert len(ranged) >= 2 and not any("unboundedfollowing" in line.lower() for line in ranged)
