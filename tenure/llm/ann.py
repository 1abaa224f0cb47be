"""Nearest neighbours from one-bit codes: estimates pick, bounds guarantee, exact distances rank.

Vectors are coded once (sign bits of the rotated direction, its factor, its length). The search is a
grid: rows in blocks by queries in blocks, a task per cell, so neither side is broadcast or
gathered. In a cell, the best ``k`` by estimate give a first exact k-th distance; every vector
whose lower bound is not beyond it is recomputed in double precision, and the cell returns its best
``k`` for each query. The best of the cells are merged by a ranking with a limit, which Spark
applies before it shuffles.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part; a vector of another length than the query's is no candidate; rows with the query's own id
are not its candidates; a query id that occurs twice is searched once, with its least vector;
ties go to the smaller id; with fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm import rotation as rot
from tenure.llm.common import stored

EPS = 3.5
#: Vectors and queries in a cell of the grid, and queries held against the vectors at a time.
ROWS, QUERIES, STEP = 16_384, 2_048, 64


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index: (vec_id, vec, dim, norm, code, factor) of every usable row."""
    rows = vectors.where(rot.usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vec"].map(len)):
                raw = np.array(part["vec"].tolist(), np.float64)
                norm = np.linalg.norm(raw, axis=1)
                packed, factor = rot.codes(raw / norm[:, None])
                yield pd.DataFrame({"vec_id": part["vec_id"], "vec": part["vec"], "dim": dim, "norm": norm,
                                    "code": [p.tobytes() for p in packed], "factor": factor})

    return rows.mapInPandas(run, "vec_id long, vec array<double>, dim int, norm double, code binary, factor double")


def _cell(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return empty
        raw, q_raw = (np.array(f["vec"].tolist(), np.float64) for f in (rows, queries))
        dim, ids, q_ids = raw.shape[1], rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        norm, factor, q_norm = rows["norm"].to_numpy(), rows["factor"].to_numpy(), queries["norm"].to_numpy()
        packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        width, out = rot.bound(factor, dim, EPS)[:, None], []

        def exact(i: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.sqrt(((raw[x] - q_raw[i]) ** 2).sum(1))

        for at in range(0, len(queries), STEP):
            qs = np.arange(at, min(at + STEP, len(queries)))
            est = rot.estimates(packed, factor, q_raw[qs] / q_norm[qs, None])
            most = np.minimum(est + width, 1)
            low = norm[:, None] ** 2 + q_norm[None, qs] ** 2 - 2 * norm[:, None] * q_norm[None, qs] * most
            own = ids[:, None] == q_ids[None, qs]
            low[own] = np.inf
            first = np.argpartition(low, min(k, len(rows)) - 1, axis=0)[:k]
            for c, i in enumerate(qs):
                seed = first[:, c][~own[first[:, c], c]]
                limit = exact(np.full(len(seed), i), seed).max() if len(seed) == k else np.inf
                # a little slack for the rounding of the bound
                x = np.flatnonzero((low[:, c] <= limit**2 * (1 + 1e-6) + 1e-12) & ~own[:, c])
                d = exact(np.full(len(x), i), x)
                best = np.lexsort((ids[x], d))[:k]
                out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[x[best]], "score": d[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows by Euclidean distance of each query row."""
    index = stored(encode(vectors, id_col, vec_col))
    asked = index.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id")
    asked = asked.groupBy("vec_id", "dim").agg(F.min(F.struct("vec", "norm")).alias("q")).select("vec_id", "dim", "q.vec", "q.norm")
    n, nq = index.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-nq // QUERIES))
    block = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    row_cells = index.withColumn("r", block(row_blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    query_cells = asked.withColumn("q", block(query_blocks, 2)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    near = query_cells.groupBy("dim", "q", "r").cogroup(row_cells.groupBy("dim", "q", "r")).applyInPandas(
        _cell(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
