"""Quality by perplexity under a modified Kneser-Ney word model of trusted text.

The model is a bigram model, interpolated with word continuation counts, with the three
discounts of modified Kneser-Ney. Words (runs of letters and digits, or of other signs, in lower
case) are told apart by 64-bit hashes, whatever the size of the vocabulary; what is left for words that
were never seen is shared evenly by the vocabulary and one word more. Nothing is bounded: counts of
bigrams, of contexts and of words are summed over all trusted documents, stay distributed tables, and
reach the documents by a join.

A document's log probability is a sum over its words of a context's back-off, a word's continuation
and a gain for every bigram that trusted text has, those seen once included. The most frequent
contexts, words and bigrams (at most ``HEAD`` each) are kept in sorted arrays in every task: they are
most of what a text asks for, and asked of a join they would be its hot keys. All others are looked up in
one table, sharded by key; a Bloom filter of fixed size first removes requests for what no
trusted text has, without error, since what passes is joined exactly. Documents ask in ``WAVES`` parts, so the
requests on disk are those of one part.

The model learns from four fifths of the trusted documents and the fifth that it has not seen sets,
per language, the quantile of perplexity beyond which documents are rejected.

Defined results: a null text, or one without words, has no perplexity and is rejected; a null
language is a language of its own; a language with fewer than ``LEAST`` held-out documents takes the
limit of all languages; without trusted text nothing is rejected but texts without words; repeated
rows get the same verdict; labels without an id, or null ones, are not trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm.common import broadcast_if_small, only_rows, partitions, release, remove_written, row_name, split_words, stored, text_slices, written, written_by_key, written_so_far

#: Contexts, words and bigrams kept in every task, and bits of the filter (16 MB).
HEAD, FILTER_BITS = 1 << 18, 27
#: Quantile of held-out perplexity, its least number of documents, and cells per unit of log perplexity.
QUANTILE, LEAST, CELLS = 0.998, 20, 256
#: Share of trusted documents held out: one of FOLDS.
FOLDS = 5
#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Parts, by the hash of a row, in which documents ask the table one after the other: the requests of one part are on disk at a time.
WAVES = 6
#: Documents and bytes of text taken at a time (every word of them has a row of several arrays in the task); bigrams summed before they are handed on.
SLICE, SLICE_BYTES, MAX_GRAMS = 2_000, 1_500_000, 500_000

#: The context of a text's first word: the hash of the empty word, which no text has.
START = pd.util.hash_array(np.array([""], object)).view(np.int64)[0]
#: What a key of the joined table stands for.
BIGRAM, CONTEXT, WORD = 0, 1, 2
#: Runs of signs are set apart from the words around them.
SIGNS = r"([^\s\p{L}\p{M}\p{N}]+)"


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and of the start, and of every word its predecessor, itself (places in them) and its document; words per document."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), SIGNS, r" \1 ")
    lists = split_words(spaced)
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.append(pd.util.hash_array(words.astype(object)).view(np.int64), START)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = (words != "")[ids] if len(words) else np.zeros(0, bool)
    own, doc = ids[full], doc[full]
    before = np.append(len(words), own[:-1]) if len(own) else own
    if len(own):
        before[np.append(True, doc[1:] != doc[:-1])] = len(words)
    return hashes, before, own, doc, np.bincount(doc, minlength=len(texts))


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the preceding and the own word and document of every word, and words per document."""
    hashes, before, own, doc, words = coded(texts)
    return hashes[before], hashes[own], doc, words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def keys_of(kind: np.ndarray | int, v: np.ndarray, w: np.ndarray | int = 0) -> np.ndarray:
    """64-bit keys of bigrams (v, w), contexts v or words v."""
    salt = np.asarray(kind, np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    first = _mixed(v.view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(first + np.asarray(w, np.int64).view(np.uint64)).view(np.int64)


def count_bigrams(docs: DataFrame) -> DataFrame:
    """(v, w, n): how often each bigram occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            v, w, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((w, v))
            v, w, n = v[order], w[order], n[order]
            at = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(w[at]), pa.array(np.add.reduceat(n, at))], names=["v", "w", "n"])

        for batch in batches:
            for part in text_slices(batch, SLICE, SLICE_BYTES):
                hashes, before, own, _, _ = coded(part.column("text"))
                pair, n = np.unique(before * len(hashes) + own, return_counts=True)
                held.append((hashes[pair // len(hashes)], hashes[pair % len(hashes)], n))
                size += len(pair)
                if size > MAX_GRAMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def _discounts(n: list[float]) -> np.ndarray:
    """The discounts for counts of 1, 2 and 3 or more, from the numbers of items that occur 1 to 4 times."""
    usual = np.array([0.0, 0.5, 1.0, 1.5])
    if min(n) <= 0:
        return usual
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.where((d > 0) & (d <= np.arange(4)), d, usual)


def _cut(times: DataFrame) -> int:
    """The count from which on there are at most HEAD items, given how many (c) have each count (n)."""
    w = W.orderBy(F.desc("n"))
    fits = times.withColumn("up_to", F.sum("c").over(w)).where(F.col("up_to") <= HEAD).agg(F.min("n")).first()[0]
    return fits if fits is not None else 1 << 62


def _times(items: DataFrame, col: str) -> DataFrame:
    return items.groupBy(F.least(col, F.lit(1 << 30)).alias("n")).agg(F.count("*").alias("c"))


def _ones(times: DataFrame) -> list[float]:
    """How many items occur 1 to 4 times."""
    sizes = times.agg(*[F.sum(F.when(F.col("n") == i, F.col("c")).otherwise(0)) for i in (1, 2, 3, 4)]).first()
    return [float(x or 0) for x in sizes]


def _off(n: str, d: np.ndarray) -> Column:
    return F.when(F.col(n) == 1, float(d[1])).when(F.col(n) == 2, float(d[2])).otherwise(float(d[3]))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(table["key"].to_numpy())
    return table["key"].to_numpy()[order], table["value"].to_numpy()[order].astype(np.float32)


class Tables:
    """The distributed tables of a model, each with the count that makes an item one of the head."""

    def __init__(self, grams: DataFrame):
        times = _times(grams, "n")
        d = _discounts(_ones(times))
        self.grams, self.off, self.cut = grams, _off("n", d), _cut(times)
        contexts = grams.groupBy("v").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(self.off).alias("saved"))
        self.contexts = written(contexts.select("v", "kinds", "saved", F.log(F.col("saved") / F.col("all")).alias("back")))
        self.context_cut = _cut(_times(self.contexts, "kinds"))
        kinds = written(grams.groupBy("w").agg(F.count("*").alias("kinds")))
        times = _times(kinds, "kinds")
        self.word_cut = _cut(times)
        off = _off("kinds", _discounts(_ones(times)))
        size, every, saved = kinds.agg(F.count("*"), F.sum("kinds"), F.sum(off)).first()
        # what is left is shared by all words and one that was never seen
        spare = (saved / every if size else 1.0) / (size + 1)
        self.unseen = float(np.log(spare))
        self.words = kinds.select("w", "kinds", ((F.col("kinds") - off) / float(every or 1) + spare).alias("share"))

    def gains(self, grams: DataFrame) -> DataFrame:
        """(v, w, value): what having been seen adds to a bigram's log probability."""

        def beside(rows: DataFrame, facts: DataFrame, key: str, value: str, cut: int) -> DataFrame:
            # at most HEAD rows, the hot keys of the join; the others are joined by a shuffle
            facts = facts.select(key, "kinds", value)
            near = rows.join(F.broadcast(facts.where(F.col("kinds") >= cut).drop("kinds")), key, "left")
            far = near.where(F.col(value).isNull()).drop(value).join(facts.where(F.col("kinds") < cut).drop("kinds"), key)
            return near.where(F.col(value).isNotNull()).unionByName(far)

        both = beside(beside(grams, self.contexts, "v", "saved", self.context_cut), self.words, "w", "share", self.word_cut)
        return both.select("v", "w", F.log1p((F.col("n") - self.off) / (F.col("saved") * F.col("share"))).alias("value"))

    def tail(self) -> DataFrame:
        """(key, value) of all bigrams, contexts and words outside the head."""
        grams = self.gains(self.grams.where(F.col("n") < self.cut))
        contexts = self.contexts.where(F.col("kinds") < self.context_cut).select("v", F.lit(0).cast("long").alias("w"), F.col("back").alias("value"))
        words = self.words.where(F.col("kinds") < self.word_cut).select(
            F.col("w").alias("v"), F.lit(0).cast("long").alias("w"), (F.log("share") - self.unseen).alias("value"))
        named = [df.select(F.lit(kind).alias("kind"), "v", "w", "value") for kind, df in ((BIGRAM, grams), (CONTEXT, contexts), (WORD, words))]
        return named[0].unionByName(named[1]).unionByName(named[2]).mapInArrow(_keyed, "key long, value float")


class Model:
    """What every task holds: the head's contexts, words and bigrams, and the filter. All of fixed size."""

    def __init__(self, tables: Tables, tail: DataFrame):
        self.unseen = tables.unseen
        self.contexts = _sorted(tables.contexts.where(F.col("kinds") >= tables.context_cut).select(F.col("v").alias("key"), F.col("back").alias("value")).toArrow())
        self.words = _sorted(tables.words.where(F.col("kinds") >= tables.word_cut).select(F.col("w").alias("key"), F.log("share").alias("value")).toArrow())
        top = tables.gains(tables.grams.where(F.col("n") >= tables.cut)).select(F.lit(BIGRAM).alias("kind"), "v", "w", "value")
        self.head = _sorted(top.mapInArrow(_keyed, "key long, value float").toArrow())
        self.filter = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bits = tail.select("key").mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.filter[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)

    def open(self, key: np.ndarray) -> np.ndarray:
        """Which keys the table may have."""
        word, bits = _filter_place(key)
        return (self.filter[word] & bits) == bits


def _look(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted array, and its value."""
    known, values = arrays
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at].astype(np.float64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, v, w, value = (batch.column(c).to_numpy() for c in ("kind", "v", "w", "value"))
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(kind, v, w)), pa.array(value.astype(np.float32))], names=["key", "value"])


def _filter_place(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the two bits in it that stand for a key."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    word = (h >> np.uint64(70 - FILTER_BITS)).astype(np.int64)
    return word, (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, bits = _filter_place(batch.column("key").to_numpy())
        order = np.argsort(word, kind="stable")
        at = np.flatnonzero(np.append(True, word[order][1:] != word[order][:-1])) if len(word) else np.zeros(0, np.int64)
        joined = np.bitwise_or.reduceat(bits[order], at) if len(at) else bits
        yield pa.RecordBatch.from_arrays([pa.array(word[order][at]), pa.array(joined.view(np.int64))], names=["word", "bits"])


def _ask(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in text_slices(batch, SLICE, SLICE_BYTES):
                rid = part.column("rid").to_numpy()
                n = len(rid)
                hashes, before, own, doc, words = coded(part.column("text"))
                size = len(hashes)
                # the same bigram of a document is asked once
                pairs, times = np.unique((doc * size + before) * size + own, return_counts=True)
                pairs, second = np.divmod(pairs, size)
                at, first = np.divmod(pairs, size)
                key = keys_of(BIGRAM, hashes[first], hashes[second])
                near, back = _look(model.contexts, hashes)
                usual, word = _look(model.words, hashes)
                top, gain = _look(model.head, key)
                known = np.where(near, back, 0)[first] + np.where(usual, word, model.unseen)[second] + np.where(top, gain, 0)
                sums = np.bincount(at, known * times, minlength=n)
                asked = [(at, key, times, ~top & model.open(key))]
                for kind, have, part_of in ((CONTEXT, near, first), (WORD, usual, second)):
                    one = keys_of(kind, hashes)
                    wanted = (~have & model.open(one))[part_of]
                    place, inverse = np.unique(at[wanted] * size + part_of[wanted], return_inverse=True)
                    asked.append((place // size, one[place % size], np.bincount(inverse, times[wanted], minlength=len(place)), np.ones(len(place), bool)))
                docs = np.concatenate([a[f] for a, _, _, f in asked])
                # a document's own row asks for nothing, so its key may be any
                m = n + len(docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([rid, rid[docs]])), pa.array(np.concatenate([rid, *[k[f] for _, k, _, f in asked]])),
                    pa.array(np.concatenate([np.zeros(n, np.int32), *[t[f].astype(np.int32) for _, _, t, f in asked]])),
                    pa.array(np.concatenate([sums, np.zeros(len(docs))]), mask=np.arange(m) >= n),
                    pa.array(np.concatenate([words, np.zeros(len(docs), np.int64)]), mask=np.arange(m) >= n),
                ], names=["rid", "key", "times", "known", "words"])

    return run


def log_perplexities(docs: DataFrame, grams: DataFrame, since: int | None = None) -> DataFrame:
    """(rid, words, loss): words and mean negative log probability of a word, per distinct row.

    The model's own tables go before anything is asked; so does what was written from the mark ``since`` on, as ``grams``.
    """
    since = written_so_far() if since is None else since
    spark = docs.sparkSession
    tables = Tables(grams)
    # stored before anything is asked, so that no task holds both steps, and dealt by key once for all waves
    tail = written_by_key(tables.tail(), "key", partitions(spark))
    release(spark)
    model = Model(tables, tail)
    # the model and the table that is asked hold all that is needed of the counts
    del tables
    remove_written(since, keep=1)
    release(spark)
    shared = spark.sparkContext.broadcast(model)
    del model
    rows = docs.select(row_name(docs).alias("rid"), "text")
    sums = None
    for wave in range(WAVES):
        some = rows.where(F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(WAVES)) == wave)
        found = some.mapInArrow(_ask(shared), "rid long, key long, times int, known double, words long").join(tail, "key", "left")
        summed = found.groupBy("rid").agg(F.sum("known").alias("known"), F.sum(F.col("times") * F.col("value")).alias("gained"), F.sum("words").alias("words"))
        # the wave's requests go with its shuffle files
        summed = stored(summed.select("rid", "words", F.when(F.col("words") > 0, -(F.col("known") + F.coalesce("gained", F.lit(0.0))) / F.col("words")).alias("loss")))
        sums = summed if sums is None else sums.unionByName(summed)
        release(spark)
    shared.destroy()
    return sums


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(label_id): documents labelled good and not toxic."""
    return labels.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("label_id")).distinct()


def limits(judged: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(language, limit): the quantile of held-out loss per language; language '*' stands for all."""
    cells = judged.where("held_out AND loss IS NOT NULL").groupBy("language", F.ceil(F.col("loss") * CELLS).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    pooled = cells.groupBy(F.lit("*").alias("language"), "cell").agg(F.sum("n").alias("n"))
    w = W.partitionBy("language")
    ranked = cells.unionByName(pooled).withColumn("all", F.sum("n").over(w)).withColumn("up_to", F.sum("n").over(w.orderBy("cell")))
    found = ranked.groupBy("language").agg((F.min(F.when(F.col("up_to") >= F.col("all") * quantile, F.col("cell"))) / CELLS).alias("limit"), F.max("all").alias("n"))
    return found.where((F.col("n") >= LEAST) | (F.col("language") == "*")).select("language", "limit")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, rid, words, perplexity, limit, kept) of every row of documents."""
    ids = broadcast_if_small(stored(trusted_ids(labels)), BROADCAST_ROWS)
    fold = F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(FOLDS))
    learned = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("label_id")).where(fold != 0)
    since = written_so_far()
    grams = written(count_bigrams(learned).sortWithinPartitions("v", "w"))
    release(docs.sparkSession)
    loss = log_perplexities(docs, grams, since)
    release(docs.sparkSession)
    rows = docs.select("doc_id", row_name(docs).alias("rid"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"))
    judged = (rows.join(loss, "rid").join(ids, F.col("doc_id") == F.col("label_id"), "left")
              .withColumn("held_out", F.coalesce(fold == 0, F.lit(False))).drop("label_id"))
    # one row per language
    found = limits(judged, quantile)
    per = found.where("language <> '*'").withColumnRenamed("limit", "own")
    pooled = found.where("language = '*'").select(F.col("limit").alias("all_limit"), F.lit(True).alias("any"))
    out = judged.withColumn("any", F.lit(True)).join(per, "language", "left").join(pooled, "any", "left").withColumn("limit", F.coalesce("own", "all_limit"))
    kept = F.coalesce((F.col("words") > 0) & ((F.col("loss") <= F.col("limit")) | F.col("limit").isNull()), F.lit(False))
    return out.select("doc_id", "rid", "words", F.exp("loss").alias("perplexity"), F.exp("limit").alias("limit"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return only_rows(docs, classify(docs, labels).where("kept").select(F.col("rid").alias("good_row")).distinct())
