"""Token counts of sections: whole documents are encoded once, tokens attributed by offset.

Encoding a section on its own gives other tokens than encoding the document that holds it.
Here the document is encoded once, every token gets its character span, and spans are
interval-joined with the document's sections. Both sides of that join sit in one row, so it is
a merge over two sorted lists inside the task and nothing is shuffled.

A token that crosses a boundary goes, by ``rule``, to the section of its first character
(``first``), of its last (``last``), or is split by characters (``split``).

Defined results: a token that no section takes is counted in a row whose section is null; a section
without tokens has a row with 0; a document without sections (a null or empty text has no lines) has one
row, whose section is null; a null text has no tokens; sections of a document must not
overlap (where they do, the one that starts last before the character takes it); null ids and
repeated rows give rows of their own; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm import bpe

RULES = ("first", "last", "split")
SECTION = "array<struct<section:string,start:int,end:int>>"


def line_ends(text: str) -> np.ndarray:
    """Ends of a text's lines, line breaks included, in characters."""
    breaks = [m.end() for m in re.finditer("\n", text)]
    return np.array(breaks if not text or breaks and breaks[-1] == len(text) else [*breaks, len(text)], np.int64)


def char_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of tokens, given their byte lengths."""
    raw = np.frombuffer(data, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1] + 1


def _holder(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index of the section that holds a character, -1 for none."""
    k = np.searchsorted(starts, at, "right") - 1
    inside = k >= 0
    inside[inside] = at[inside] < ends[k[inside]]
    return np.where(inside, k, -1)


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section (sorted by start), and of none in the last place."""
    n = len(starts)
    if rule in ("first", "last"):
        where = _holder(first if rule == "first" else end - 1, starts, ends)
        return np.bincount(np.where(where < 0, n, where), minlength=n + 1).astype(np.float64)
    lengths = end - first
    chars = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)
    where = _holder(chars, starts, ends)
    return np.bincount(np.where(where < 0, n, where), np.repeat(1 / lengths, lengths), minlength=n + 1)


def with_sections(docs: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Attach a table (id, section, start, end) of spans as the array that ``count`` reads."""
    spans = sections.where("start IS NOT NULL AND end IS NOT NULL").groupBy(F.col(id_col).alias("_sid")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("_s"))
    packed = F.transform(F.coalesce("_s", F.array()), lambda s: F.struct(
        s["section"].cast("string").alias("section"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return docs.join(spans, F.col(id_col) == F.col("_sid"), "left").withColumn("sections", packed).drop("_sid", "_s")


def count(docs: DataFrame, ranks_path: str, pattern: str, sections: str | None = None, rule: str = "first",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens) for every section of every row.

    ``sections`` names a column of type array<struct<section, start, end>> of character spans;
    without it the sections are the text's lines, line breaks included, numbered from 0.
    """
    if rule not in RULES:
        raise ValueError(rule)
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.col(sections).cast(SECTION).alias("sections")] if sections else []))
    schema = "doc_id long, section string, start int, end int, n_tokens double"

    def of_row(enc: bpe.Encoder, sizes: np.ndarray, text: str, spans) -> list[tuple]:
        ids = np.frombuffer(enc.ids(text), "<u4")
        if sections is None:
            ends = line_ends(text)
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            names = [str(i) for i in range(len(ends))]
        else:
            spans = sorted((s for s in spans or () if s and s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"]))
            starts, ends = (np.array([s[k] for s in spans], np.int64) for k in ("start", "end"))
            names = [s["section"] for s in spans]
        first, end = char_spans(text.encode(), sizes[ids]) if len(ids) else (np.zeros(0, np.int64),) * 2
        n = attribute(first, end, starts, ends, rule)
        out = [(names[k], int(starts[k]), int(ends[k]), float(n[k])) for k in range(len(starts))]
        # a document without sections has a row too
        return out + ([(None, None, None, float(n[-1]))] if n[-1] or not out else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(shared.value, pattern)
        sizes = np.array([len(t) for t in enc.tokens], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = part.column("sections").to_pylist() if sections else [None] * part.num_rows
                found = [(d.as_py(), *r) for d, t, s in zip(part.column("doc_id"), part.column("text"), spans) for r in of_row(enc, sizes, t.as_py() or "", s)]
                columns = list(zip(*found)) if found else [[]] * 5
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "section", "start", "end", "n_tokens"])

    return rows.mapInArrow(run, schema)
