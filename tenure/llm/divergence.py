"""Source divergence audit: terms by iceberg prefix refinement, then exact rates of every source.

A term is a run of letters and bytes beyond ASCII. A language keeps the terms that enough of its documents
hold. They are found from the left: the distinct-document count of a byte prefix is at least that of every term
that starts with it, so a prefix below the threshold is discarded with all its terms, and only the others are
extended at the next level, until the terms that remain are complete (a term ends in a zero byte, which no
term holds, so being complete is a prefix too).

Distinct documents are counted without document ids. A task sorts the distinct terms of each document; a term is
the document's first with a prefix of length L exactly if it shares fewer than L bytes with the term before it.
So each task emits (language, term, bytes shared, documents), summed over the documents of a slice of its input, and
the documents with a prefix are the sum over rows that share fewer than L bytes. What all levels read is this
table; a frequent term is one row for each slice, whatever its number of documents. Rows meet the kept prefixes of the last
level by a 64-bit hash: a chance hit is counted again, exactly, at the next. Occurrences per source come from a second scan, which hands on kept terms only.

Rates are exact: integer division of decimals of 38 digits in Spark, sums of whole numbers in the tasks. Pairs of
sources are summed in buckets of a language's terms with a bounded number of (term, source) cells; a bucket
emits one number for each pair of sources, which is the shape of the result.

Defined results: null text, language and source are the empty string; every row is a document of its own, also
repeated ones; a document without terms, and a language without kept terms, still has its groups; a language with one
source has no pairs; no documents, no rows; other columns are not read. Very long texts and terms are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.llm import common

#: Documents of a language that a kept term needs, smoothing, and parts of one.
MIN_DOCS, SMOOTH, SCALE = 30, 5, 1_000_000_000
#: Ranks of the term part.
TOP = 50
#: Prefix lengths in bytes of the first levels; later ones are half as long again.
LEVELS = (3, 5, 7, 9, 12, 16)
#: Hashes of kept prefixes that are broadcast at most (a long each), and (term, source) cells of a bucket, about.
BROADCAST_ROWS, CELLS = 500_000, 20_000
#: Text that a task takes at a time (one document at least).
SLICE_BYTES = 8_000_000

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    array = array.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0]:ends[-1]]


def _binary(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def terms(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document number and folded bytes of every term, in order."""
    ends, raw = _bytes(text)
    folded = _FOLD[raw]
    inside = folded != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    # a document's border ends a term
    border = ends[1:-1]
    at = border[border < len(raw)]
    start[at] = inside[at]
    before = border[border > 0] - 1
    stop[before] = inside[before]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    return np.searchsorted(ends, first, "right") - 1, _binary(last + 1 - first, folded[inside])


def shared_bytes(words: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two words, by their numbers."""
    ends, raw = _bytes(words)
    a, b = ends[left], ends[right]
    most = np.minimum(ends[left + 1] - a, ends[right + 1] - b)
    out = np.zeros(len(left), np.int64)
    open_ = np.flatnonzero(most > 0)
    for k in range(48):
        if not len(open_):
            return out
        open_ = open_[raw[a[open_] + k] == raw[b[open_] + k]]
        out[open_] = k + 1
        open_ = open_[most[open_] > k + 1]
    for i in open_:  # the few that share very long prefixes
        x, y = raw[a[i]:a[i] + most[i]], raw[b[i]:b[i] + most[i]]
        differs = x != y
        out[i] = int(differs.argmax()) if differs.any() else most[i]
    return out


def _sorted_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document, word and number of occurrences of every distinct term of a document, sorted; and the words, sorted by bytes."""
    doc, words = terms(pc.fill_null(texts, ""))
    coded = words.dictionary_encode()
    by_bytes = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(by_bytes)
    rank = np.empty(len(words), np.int64)
    rank[by_bytes.to_numpy()] = np.arange(len(words))
    key, times = np.unique(doc * max(1, len(words)) + rank[coded.indices.to_numpy()], return_counts=True)
    return key // max(1, len(words)), key % max(1, len(words)), times, words


def _summed(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of values over rows whose keys are all equal; the last key varies slowest."""
    if not len(values):
        return keys, values
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(values[order], at)


def document_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, term, shared, docs) of a slice."""
    doc, word, _, words = _sorted_terms(batch.column("text"))
    shared = np.zeros(len(doc), np.int64)
    follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    shared[follows] = shared_bytes(words, word[follows - 1], word[follows])
    langs = batch.column("lang").dictionary_encode()
    (shared, word, lang), docs = _summed([shared, word, langs.indices.to_numpy()[doc]], np.ones(len(doc), np.int64))
    return pa.table({"lang": langs.dictionary.take(pa.array(lang)), "term": words.take(pa.array(word)), "shared": pa.array(shared, pa.int32()), "docs": docs})


def occurrences(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n) of a slice."""
    doc, word, times, words = _sorted_terms(batch.column("text"))
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    (word, source, lang), n = _summed([word, sources.indices.to_numpy()[doc], langs.indices.to_numpy()[doc]], times)
    return pa.table({"lang": langs.dictionary.take(pa.array(lang)), "source": sources.dictionary.take(pa.array(source)), "term": words.take(pa.array(word)), "n": n})


def _by_slices(rows_of):
    """The rows of each slice of a task's input, in batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, rows=20_000, size=SLICE_BYTES):
                rows = rows_of(part)
                rows = rows.set_column(rows.column_names.index("term"), "term", rows["term"].cast(pa.binary()))
                yield from rows.to_batches(max_chunksize=100_000)

    return run


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, shared, docs) of ``docs`` (lang, text), summed inside slices."""
    return docs.select("lang", "text").mapInArrow(_by_slices(document_counts), "lang string, term binary, shared int, docs long")


def source_rows(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n) of ``docs``, summed inside slices."""
    return docs.select("lang", "source", "text").mapInArrow(_by_slices(occurrences), "lang string, source string, term binary, n long")


def _prefix(length: int) -> Column:
    """The first bytes of a term; a term that ends within them brings its end mark."""
    return F.substring(F.concat(F.col("term"), F.lit(b"\0")), 1, length)


def with_prefixes(rows: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """The rows whose prefix may be in ``kept`` (lang, prefix): none that is gets lost."""
    names = kept.select(F.xxhash64("lang", "prefix").alias("kept_hash")).distinct()
    return rows.join(common.broadcast_if_small(names, BROADCAST_ROWS), F.xxhash64("lang", _prefix(length)) == F.col("kept_hash"), "left_semi")


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS, levels=LEVELS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of their language."""
    found, alive, level, length = None, None, 0, 0
    while True:
        longer = levels[level] if level < len(levels) else length * 3 // 2
        here = rows if alive is None else with_prefixes(rows.where(F.octet_length("term") >= length), alive, length)
        counts = here.where(F.col("shared") < longer).groupBy("lang", _prefix(longer).alias("prefix")).agg(F.sum("docs").alias("docs"))
        large = common.stored(counts.where(F.col("docs") >= min_docs).select("lang", "prefix"))
        whole = F.substring("prefix", -1, 1) == F.lit(b"\0")
        done = large.where(whole).select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"))
        found = done if found is None else found.unionByName(done)
        alive = large.where(~whole)
        if alive.isEmpty():
            return found
        length, level = longer, level + 1


def rate(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly; 0 without kept terms."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + CAST(CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))"
                  f" div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20, 0)) AS BIGINT) ELSE 0 END")


def _pair_sums(key, cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of rate differences over a bucket's terms, one row for each pair of sources."""
    sources = sources.sort_values("source")
    names = sources["source"].to_numpy(object)
    row = {s: i for i, s in enumerate(names)}
    term, columns = pd.factorize(cells["term"].to_numpy())
    table = np.repeat(sources["p_none"].to_numpy(np.int64)[:, None], len(columns), axis=1)
    table[cells["source"].map(row).to_numpy(np.int64), term] = cells["p"].to_numpy(np.int64)
    left, right, value = [], [], []
    for i in range(len(names) - 1):
        left += [names[i]] * (len(names) - 1 - i)
        right += list(names[i + 1:])
        value += np.abs(table[i + 1:] - table[i]).sum(axis=1).tolist()
    texts = {c: pd.Series(v, dtype=object) for c, v in (("lang", [key[0]] * len(left)), ("source", left), ("item", right))}
    return pd.DataFrame({**texts, "value": np.array(value, np.int64)})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and the terms a source has too much of."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    rows = common.written(term_rows(named))
    kept = common.stored(kept_terms(rows, min_docs))
    likely = with_prefixes(source_rows(named), kept.select("lang", F.concat("term", F.lit(b"\0")).alias("prefix")), 1 << 30)
    counts = common.written(likely.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
                            .select("lang", "source", "term", "n"))

    # one row for each group, and for each language
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, "total")
    kept_in = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(kept_in, "lang", "left").fillna(0, "kept")
    of_lang = W.partitionBy("lang")
    # a bucket emits a number for each pair of sources, so it has at least as many cells
    sources = F.count("*").over(of_lang)
    buckets = F.ceil(F.col("kept") * sources / F.greatest(F.lit(CELLS), sources * sources))
    groups = groups.withColumn("lang_total", F.sum("total").over(of_lang)).withColumn("buckets", F.greatest(F.lit(1).cast("long"), buckets))
    groups = common.stored(groups.withColumn("none", F.lit(0).cast("long")).withColumn("p_none", rate("none", "total", "kept")))

    rated = counts.join(groups.select("lang", "source", "total", "lang_total", "kept", "buckets"), ["lang", "source"]).withColumn("p", rate("n", "total", "kept"))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    over = (rated.join(in_lang, ["lang", "term"]).withColumn("value", F.col("p") - rate("lang_n", "lang_total", "kept")).where("value > 0")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value"))

    cells = rated.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"))
    spread = groups.select("lang", "source", "p_none", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    sums = cells.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("b"), "value").select("lang", "b.source", F.lit("pair").alias("part"), "b.item", "value")

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = F.row_number().over(by_value).alias("rank")
    # ranks to ``top`` are cut inside the tasks before rows meet
    first = over.select("*", ranked).where(F.col("rank") <= top)
    return pairs.select("*", ranked).unionByName(first).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
