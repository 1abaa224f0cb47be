"""Near-duplicate vectors: code bands propose, unbiased estimates with bounds decide, exact cosines confirm.

Equal vectors of a label are one row with a count from the start. Bands of ``k`` sign bits, taken
from random rotations, put vectors into buckets inside their label; ``k`` follows the number
of vectors, and the number of bands follows ``k`` so that a pair at the threshold meets with
probability ``RECALL`` at least. In a bucket a pair's inner product is estimated from the code
of one and the rotated other; pairs whose upper bound stays below the threshold are out, all
others are recomputed in double precision. A pair counts in the first band in which it meets,
so links are counted without listing pairs. Large buckets are cut into blocks, a task per
pair of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, have no links and are their own component; vectors of different length
never link; repeated rows are vectors of their own, each a link of the other; ids may be null
(the component is then named by the least id there is, null if none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm import rotation as rot
from tenure.llm.common import stored
from tenure.llm.components import components

THRESHOLD = 0.93
#: Least probability that a pair at the threshold meets in some band.
RECALL = 0.9999
#: Width of the confidence bounds in standard deviations.
EPS = 4.5
#: Vectors a bucket should hold on average, and at most in a block.
BUCKET, BLOCK = 128, 1024


def band_plan(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands, for the largest number of vectors in a label."""
    k = max(2, math.ceil(math.log2(max(largest, 1) / BUCKET + 1)))
    meet = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _bands(unit: np.ndarray, k: int, n: int) -> np.ndarray:
    """(rows, bands) of k-bit values; rotations are added until there are bits enough."""
    dim = unit.shape[1]
    turns = math.ceil(n * k / dim)
    bits = np.concatenate([unit @ rot.rotation(dim, 1 + t) > 0 for t in range(turns)], axis=1)[:, : n * k]
    return bits.reshape(len(unit), n, k) @ (1 << np.arange(k))


def link(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    vec = F.col(vec_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("part", rot.usable(F.col("vec")) & F.col("label").isNotNull())
    keyed = rows.withColumn("key", F.when(F.col("part"), F.xxhash64("label", "vec")))
    # equal vectors of a label; two different ones share a 64-bit key with negligible probability
    distinct = stored(keyed.where("part").groupBy("key", "label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")))
    largest = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, n_bands = band_plan(largest, threshold)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["vec"].map(len)):
                unit = np.array(part["vec"].tolist(), np.float64)
                unit /= np.abs(unit).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                packed, factor = rot.codes(unit)
                yield pd.DataFrame({"key": part["key"], "label": part["label"], "dim": dim, "vec": part["vec"], "copies": part["copies"],
                                    "code": [p.tobytes() for p in packed], "factor": factor, "bands": list(_bands(unit, k, n_bands))})

    schema = "key long, label string, dim int, vec array<float>, copies long, code binary, factor double, bands array<long>"
    if dict(distinct.dtypes)["vec"] == "array<double>":
        schema = schema.replace("array<float>", "array<double>")
    coded = stored(distinct.select("key", "label", "vec", "copies").mapInPandas(sign, schema))

    bucket = ["label", "dim", "band", "value"]
    placed = coded.select("key", "label", "dim", F.posexplode("bands").alias("band", "value"))
    full = placed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = coded.select("*", F.posexplode("bands").alias("band", "value")).join(full.drop("n"), bucket)
    own = F.pmod(F.xxhash64("key", F.lit(7)), "blocks").cast("int")
    cells = (members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        band, dim = int(frame["band"].iloc[0]), int(frame["dim"].iloc[0])
        a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        frame = frame.sort_values("key", ignore_index=True)
        raw = np.array(frame["vec"].tolist(), np.float64)
        unit = raw / np.abs(raw).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        packed = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1)
        factor, own, copies, keys = (frame[c].to_numpy() for c in ("factor", "own", "copies", "key"))
        bands = np.array(frame["bands"].tolist())
        width = rot.bound(factor, dim, EPS)
        links, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for at in range(0, len(frame), BLOCK // 2):
            rows_ = slice(at, at + BLOCK // 2)
            est = rot.estimates(packed[rows_], factor[rows_], unit)
            i, j = np.nonzero(est + width[rows_, None] >= threshold)
            i += at
            # a pair once: in key order, and across blocks only if they differ
            keep = (i < j) & ((own[i] != own[j]) if a != b else True)
            i, j = i[keep], j[keep]
            # in slices, so that many survivors take no more memory than few
            for s in range(0, len(i), 65_536):
                x, y = i[s:s + 65_536], j[s:s + 65_536]
                near = np.einsum("nd,nd->n", unit[x], unit[y]) >= threshold
                x, y = x[near], y[near]
                met = (bands[x, :band] == bands[y, :band]).any(1) if band else np.zeros(len(x), bool)
                x, y = x[~met], y[~met]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist()):
                    while root[p] != p:
                        root[p] = p = root[root[p]]
                    while root[q] != q:
                        root[q] = q = root[root[q]]
                    root[max(p, q)] = min(p, q)
        for p in range(len(root)):
            root[p] = root[root[p]]
        hit = links > 0
        return pd.DataFrame({"key": keys[hit], "root": keys[root[hit]], "links": links[hit]})

    found = stored(cells.select("key", "copies", "code", "factor", "vec", "bands", "own", "a", "b", *bucket)
                   .groupBy(*bucket, "a", "b").applyInPandas(compare, "key long, root long, links long"))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    least = (comp.join(distinct.select(F.col("key").alias("node"), "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("comp_id")))
    named = comp.join(least, "root").select(F.col("node").alias("key"), "comp_id")
    facts = (distinct.select("key", "first_id", "copies").join(linked, "key", "left").join(named, "key", "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp_id", "first_id").alias("comp")))
    out = keyed.select("vec_id", "key").join(facts, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("comp"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
