"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

A language's model covers the characters of its words: every letter and the space that ends a
word, given up to ``ORDER - 1`` characters back to the space before the word. Counts are sums over
all learning documents; probabilities are joins over the table of n-grams. What a task loads is, per
language and order, a sorted array of n-gram hashes with log probabilities and one of contexts
with back-off weights. Hashes have 64 bits and n-grams are never merged or capped: the broadcast has
12 bytes for every distinct n-gram and context of a language, and grows with their number.

A document gets the language with the lowest cross-entropy per character. Rejection is calibrated:
per language and length class, a document is rejected if its cross-entropy lies further above the
median of the learning documents than ``SPREAD`` robust standard deviations, and further than
``SLACK`` bits.

Defined results: a text that is null or has no letter is ``und``, score 0, rejected; documents
without a language are not learned from; without any learning document all are ``und``; equal
entropies go to the first language by name; null ids count as an empty id in the split; repeated
rows are counted and judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm.common import only_rows, release, row_name, split_words, stored, text_slices

ORDER = 4
#: Robust standard deviations and bits above the median at which a document is rejected, and the least
#: number of learning documents for which a length class has its own limit.
SPREAD, SLACK, CLASS_ROWS = 12.0, 0.5, 50
#: Words whose scores a worker keeps; documents it takes at a time; n-grams it sums before it hands them on.
MAX_WORDS, SLICE, COUNT_SLICE, MAX_GRAMS = 300_000, 2_000, 5_000, 1_000_000
#: Cells of cross-entropy per bit in the calibration.
CELLS = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct lower-case words (runs of letters) of some texts: the words of each as indices, and offsets."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " ")
    lists = split_words(letters)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words leaves an empty string
        keep = ~empty[ids]
        offsets = np.append(0, np.cumsum(keep))[offsets]
        ids = (np.cumsum(~empty) - 1)[ids[keep]]
        words = words.filter(pa.array(~empty))
    return words, ids, offsets


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of the words and their closing spaces.

    Returns the hashes by order (of position 0 too, the opening space), how far back each
    position may look, and the word of each position.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.arange(len(codes))
    space = np.where(codes == 32, place, -1)
    before = np.append(-1, np.maximum.accumulate(space)[:-1])
    back = place - before
    back[0] = 0
    word = np.cumsum(np.append(0, (codes == 32)[:-1])) - 1
    hashes = [_mixed(codes + np.uint64(1))]
    for n in range(2, order + 1):
        far = np.zeros(len(codes), np.uint64)
        far[n - 1:] = codes[: len(codes) - n + 1]
        hashes.append(_mixed(hashes[-1] * _MIX + far + np.uint64(n << 40)))
    return hashes, back, word, codes


def _count_grams(words: list[str], times: np.ndarray, order: int) -> dict[str, np.ndarray]:
    """n-gram rows of words that occur ``times``: order, hash, context, suffix, start flag, count."""
    hashes, back, word, codes = grams(words, order)
    out = {k: [] for k in ("n", "h", "ctx", "suf", "opens", "c")}
    for n in range(1, order + 1):
        p = np.flatnonzero((back >= n - 1) & (np.arange(len(back)) > 0))
        h, first, inverse = np.unique(hashes[n - 1][p], return_index=True, return_inverse=True)
        at = p[first]
        out["n"].append(np.full(len(h), n, np.int32))
        out["h"].append(h)
        out["ctx"].append(hashes[n - 2][at - 1] if n > 1 else np.zeros(len(h), np.uint64))
        out["suf"].append(hashes[n - 2][at] if n > 1 else np.zeros(len(h), np.uint64))
        out["opens"].append((back[at] == n - 1) & (n > 1))
        out["c"].append(np.bincount(inverse, times[word[p]]).astype(np.int64))
    return {k: np.concatenate(v) for k, v in out.items()}


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, h, ctx, suf, opens, c): n-gram counts of all rows of (text, lang)."""
    schema = "lang string, n int, h long, ctx long, suf long, opens boolean, c long"
    names = ["n", "h", "ctx", "suf", "opens", "c"]

    def flush(lang: str, parts: list[dict]) -> pa.RecordBatch:
        cols = {k: np.concatenate([p[k] for p in parts]) for k in names}
        key = cols["h"] ^ cols["n"].astype(np.uint64) * _MIX
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        sums = np.bincount(inverse, cols["c"]).astype(np.int64)
        arrays = [pa.array([lang] * len(first), pa.string()), pa.array(cols["n"][first])]
        arrays += [pa.array(cols[k][first].view(np.int64)) for k in ("h", "ctx", "suf")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(cols["opens"][first]), pa.array(sums)], names=["lang", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch, COUNT_SLICE):
                langs = part.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    words, ids, _ = words_of(part.column("text").filter(pc.equal(langs.indices, k)))
                    if not len(words):
                        continue
                    rows = _count_grams(words.to_pylist(), np.bincount(ids, minlength=len(words)), order)
                    held.setdefault(lang, []).append(rows)
                    size[lang] = size.get(lang, 0) + len(rows["h"])
                    if size[lang] > MAX_GRAMS:
                        yield flush(lang, held.pop(lang))
                        size[lang] = 0
        for lang, parts in held.items():
            yield flush(lang, parts)

    partial = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, schema)
    return partial.groupBy("lang", "n", "h").agg(F.min("ctx").alias("ctx"), F.min("suf").alias("suf"), F.bool_or("opens").alias("opens"), F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Interpolated probabilities (lang, n, h, p) and context weights (lang, n, ctx, bow) for n-grams of order n.

    The highest order and n-grams that open a word weigh by their count; all others by the number of
    different characters seen before them.
    """
    left = counts.groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suf").alias("h")).agg(F.count("*").alias("kinds"))
    a = F.when((F.col("n") == order) | F.col("opens"), F.col("c")).otherwise(F.coalesce("kinds", "c"))
    # each step starts from a stored table, so its plan stays short
    rows = stored(counts.join(left, ["lang", "n", "h"], "left").select("lang", "n", "h", "ctx", "suf", a.alias("a")))
    n1, n2 = F.count_if(F.col("a") == 1), F.count_if(F.col("a") == 2)
    discount = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)
    steps = rows.groupBy("lang", "n").agg(discount.alias("d"))
    contexts = stored(rows.groupBy("lang", "n", "ctx").agg(F.sum("a").alias("all"), F.count("*").alias("kinds"))
                      .join(steps, ["lang", "n"]).withColumn("bow", F.col("d") * F.col("kinds") / F.col("all")))
    direct = stored(rows.join(contexts, ["lang", "n", "ctx"]).select(
        "lang", "n", "h", "suf", ((F.col("a") - F.col("d")) / F.col("all")).alias("top"), "bow", "kinds"))
    release(counts.sparkSession)
    # one more kind for characters never seen
    lower = direct.where("n = 1").select("lang", "n", "h", (F.col("top") + F.col("bow") / (F.col("kinds") + 1)).alias("p"))
    every = lower
    for n in range(2, order + 1):
        below = lower.select("lang", F.col("h").alias("suf"), F.col("p").alias("below"))
        lower = stored(direct.where(F.col("n") == n).join(below, ["lang", "suf"], "left").select(
            "lang", "n", "h", (F.col("top") + F.col("bow") * F.coalesce("below", F.lit(0.0))).alias("p")))
        every = every.unionByName(lower)
    return every, contexts.select("lang", "n", "ctx", "bow", "kinds")


def load(counts: DataFrame, order: int = ORDER) -> dict:
    """Sorted arrays of the 64-bit hashes of all languages, with log probabilities and back-off weights."""
    probs, contexts = kneser_ney(counts, order)
    p = probs.select("lang", "n", F.col("h").alias("k"), F.log("p").cast("float").alias("v")).toArrow()
    b = contexts.where("n > 1").select("lang", "n", F.col("ctx").alias("k"), F.log("bow").cast("float").alias("v")).toArrow()
    unseen = {r.lang: float(np.log(r.u)) for r in contexts.where("n = 1").select("lang", (F.col("bow") / (F.col("kinds") + 1)).alias("u")).collect()}
    langs = sorted(unseen)

    def arrays(table: pa.Table, lang: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        part = table.filter(pc.and_(pc.equal(table["lang"], lang), pc.equal(table["n"], n))).sort_by("k")
        return part["k"].to_numpy(), part["v"].to_numpy()

    return {"langs": langs, "order": order, "unseen": [unseen[x] for x in langs],
            "p": [[arrays(p, x, n) for n in range(1, order + 1)] for x in langs], "bow": [[arrays(b, x, n) for n in range(2, order + 1)] for x in langs]}


def _look(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted array, and its value."""
    known, values = arrays
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Log probability of each word under each language."""
    hashes, back, word, _ = grams(words, model["order"])
    keys = [h.view(np.int64) for h in hashes]
    out = np.empty((len(words), len(model["langs"])), np.float64)
    for j in range(len(model["langs"])):
        found, value = _look(model["p"][j][0], keys[0][1:])
        logp = np.where(found, value, model["unseen"][j]).astype(np.float64)
        for n in range(2, model["order"] + 1):
            valid = back[1:] >= n - 1
            found, value = _look(model["p"][j][n - 1], keys[n - 1][1:])
            seen, bow = _look(model["bow"][j][n - 2], keys[n - 2][:-1])
            logp = np.where(valid & found, value, logp + np.where(valid & seen, bow, 0))
        out[:, j] = np.bincount(word[1:], logp, minlength=len(words))
    return out


class _Scorer:
    """Scores of recent words in a worker."""

    def __init__(self, model: dict):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, len(model["langs"])))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MAX_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        fresh = [w for w in words if w not in self.known]
        if fresh:
            base = len(self.known)
            self.known.update(zip(fresh, range(base, base + len(fresh))))
            need = base + len(fresh)
            if need > len(self.scores):
                grown = np.empty((max(need, 2 * len(self.scores)), self.scores.shape[1]))
                grown[:base] = self.scores[:base]
                self.scores = grown
            self.scores[base:need] = word_scores(fresh, self.model)
        return self.scores[[self.known[w] for w in words]]


def score(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, ..., pred, bits, chars, sure): best language, its bits per character, characters, confidence.

    ``shared`` is the model of ``load``. Columns of ``docs`` other than text are kept.
    """
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", pred string, bits double, chars long, sure double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        langs = pa.array(shared.value["langs"], pa.string())
        for batch in batches:
            for part in text_slices(batch, SLICE):
                words, ids, offsets = words_of(part.column("text"))
                n = part.num_rows
                chars = np.zeros(n, np.int64)
                best, bits, sure = np.full(n, -1), np.full(n, np.nan), np.zeros(n)
                filled = np.flatnonzero(np.diff(offsets) > 0)
                if len(filled) and len(langs):
                    table = scorer.rows(words.to_pylist())
                    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False) + 1
                    chars[filled] = np.add.reduceat(lengths[ids], offsets[filled])
                    total = np.add.reduceat(table[ids], offsets[filled], axis=0)
                    rate = -total / np.log(2) / chars[filled, None]
                    best[filled] = rate.argmin(1)
                    bits[filled] = rate.min(1)
                    # evidence counts with the square root of the length
                    odds = np.exp(-(rate - rate.min(1, keepdims=True)) * np.sqrt(chars[filled, None]))
                    sure[filled] = 1 / odds.sum(1)
                pred = langs.take(pa.array(np.where(best < 0, 0, best), mask=best < 0)) if len(langs) else pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pred, pa.array(bits, mask=best < 0), pa.array(chars), pa.array(sure)],
                                                 names=[*keep, "pred", "bits", "chars", "sure"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def limits(scored: DataFrame, learned: Column, spread: float = SPREAD, slack: float = SLACK) -> DataFrame:
    """(pred, size_class, limit): bits per character above which a document is rejected.

    Medians and quartiles come from counts per cell of 1 / CELLS bit, a table of bounded size.
    """
    rows = scored.where(learned & F.col("pred").isNotNull())
    cells = rows.groupBy("pred", F.floor(F.log2("chars")).cast("int").alias("size_class"), F.round(F.col("bits") * CELLS).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    pooled = cells.groupBy("pred", F.lit(-1).alias("size_class"), "cell").agg(F.sum("n").alias("n"))
    w = W.partitionBy("pred", "size_class")
    ranked = (cells.unionByName(pooled).withColumn("all", F.sum("n").over(w)).withColumn("up_to", F.sum("n").over(w.orderBy("cell"))))
    q = lambda f: F.min(F.when(F.col("up_to") >= F.col("all") * f, F.col("cell"))) / CELLS
    stats = ranked.groupBy("pred", "size_class").agg(q(0.5).alias("mid"), q(0.75).alias("high"), F.max("all").alias("n"))
    sigma = F.greatest((F.col("high") - F.col("mid")) / 0.6745, F.lit(2.0 / CELLS))
    return stats.where((F.col("n") >= CLASS_ROWS) | (F.col("size_class") == -1)).select("pred", "size_class", (F.col("mid") + F.greatest(spread * sigma, F.lit(slack))).alias("limit"))


def identify(docs: DataFrame, learn: Column | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected, learned) of every row of documents.

    ``learn`` says which rows may be learned from (those with a language, unless narrowed).
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)).alias("learned"))
    learned = F.col("learned") & F.col("lang").isNotNull()
    counts = stored(count(rows.where(learned), order))
    spark = docs.sparkSession
    release(spark)
    shared = spark.sparkContext.broadcast(load(counts, order))
    release(spark)
    judged = stored(score(rows.select("doc_id", "text", (learned & (F.col("lang") != "")).alias("learned")), shared))
    shared.destroy()
    lim = limits(judged, F.col("learned"))
    own = lim.where("size_class >= 0").withColumnRenamed("limit", "own_limit")
    pool = lim.where("size_class = -1").select("pred", F.col("limit").alias("pool_limit"))
    out = (judged.withColumn("size_class", F.floor(F.log2("chars")).cast("int")).join(own, ["pred", "size_class"], "left").join(pool, "pred", "left"))
    known = F.col("pred").isNotNull()
    return out.select("doc_id", F.coalesce("pred", F.lit("und")).alias("lang_pred"), F.when(known, F.col("sure")).otherwise(0.0).alias("score"), "bits",
                      F.coalesce(~known | (F.col("bits") > F.coalesce("own_limit", "pool_limit")), F.lit(False)).alias("rejected"), "learned")


def remainder(id_col: str, m: int = 3) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; equal rows get the same verdict."""
    judged = identify(docs.select(row_name(docs).alias("doc_id"), "text", "lang"))
    return only_rows(docs, judged.where(~F.col("rejected")).select(F.col("doc_id").alias("known_row")).distinct())
