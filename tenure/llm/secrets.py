"""Secret scan by corpus-wide ownership: who else has this value?

Every text is scanned whole for three kinds of base spans (an assignment to a secret's name, a cloud access key, a
hex run) and for opaque tokens that no base span covers. Each value is named by a hash, and for each hash the
distinct repositories and owners that hold it are counted over the whole corpus. A value that many owners have is a
copied example; one that few have, and that does not look like a placeholder, is live-looking. Base spans always stay and
only carry that verdict; an opaque token becomes a span exactly if it is live-looking.

Skew: repositories and owners are counted by distinct (hash, owner, repository) first, so a value in a third of all documents collapses inside
the tasks. Verdicts come back to the occurrences by a join on the hash in which the most frequent hashes, at most
``common.HOT_KEYS`` by construction, are broadcast and the others shuffled. Documents get their spans back by a row number that
is written with the scan, so no two rows share it.

Defined results: a null text is empty and has no span; rows are judged one by one, so repeated rows repeat their result; a
null owner or repository is an owner or repository of its own; an empty table gives no rows; other columns are not read. Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm import common

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Opaque tokens: long runs with lower case, upper case and digits, and many different characters.
TOKEN = re.compile(r"[A-Za-z0-9_+=-]{20,}")
TOKEN_HAS = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))
TOKEN_DISTINCT = 10
#: Words of placeholders, in lower case, and the fewest different characters of a live-looking value.
PLACEHOLDERS = ("changeme", "dummy", "example", "placeholder", "sample", "test", "xxxx", "your")
LIVE_DISTINCT = 6
#: A value is a copied example from this many owners and repositories on.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5

_SPAN = "struct<start:int,kind:int,end:int>"
SCAN = f"doc_id {{id}}, owner string, repository string, base array<{_SPAN}>, values array<struct<start:int,kind:int,end:int,hash:binary,plain:boolean>>"
_SPAN_TYPE = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
_VALUES_TYPE = pa.list_(pa.struct([*_SPAN_TYPE, ("hash", pa.binary()), ("plain", pa.bool_())]))


def looks_plain(value: str) -> bool:
    """A placeholder by its own look."""
    return len(set(value)) < LIVE_DISTINCT or any(word in value.lower() for word in PLACEHOLDERS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    # a shorter run that starts inside a run can't be long enough, so the length is part of the pattern
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens that look random and touch no base span."""
    found, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        value = m.group()
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and len(set(value)) >= TOKEN_DISTINCT and all(has.search(value) for has in TOKEN_HAS):
            found.append((m.start(), 3, m.end(), value))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.text_slices(batch, rows=5_000):
            base, values = [], []
            for text in part.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
                values.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).digest()[:16], "plain": looks_plain(v)}
                               for s, k, e, v in spans + opaque_tokens(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "owner", "repository")], pa.array(base, pa.list_(pa.struct(_SPAN_TYPE))), pa.array(values, _VALUES_TYPE)],
                names=["doc_id", "owner", "repository", "base", "values"])


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Every row with its number, base spans and values, written once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repository_col).cast("string").alias("repository"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scan, SCAN.format(id=rows.schema["doc_id"].dataType.simpleString()))
    return common.written(out.withColumn("row", F.monotonically_increasing_id()))


def ownership(values: DataFrame) -> DataFrame:
    """(hash, times, repositories, owners) of every value: distinct counts over the whole corpus."""
    places = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("times"))
    owners = places.groupBy("hash", "owner").agg(F.sum("times").alias("times"), F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("times").alias("times"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def copied(owners: Column, repositories: Column) -> Column:
    return (owners >= COPIED_OWNERS) & (repositories >= COPIED_REPOSITORIES)


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans, n_live, n_copied, base_listing, listing) of every row.

    ``base`` and ``spans`` are arrays of (start, kind, end), kinds numbered as in ``KINDS``; the listings name them
    as ``kind:start:end``, comma-joined. ``n_live`` and ``n_copied`` count live-looking values and copied examples among all
    spans found, opaque tokens that were left out included.
    """
    rows = scanned(docs, id_col, text_col, owner_col, repository_col)
    # one table row for each occurrence of a value
    values = rows.select("row", "owner", "repository", F.explode("values").alias("v")).select("row", "owner", "repository", "v.*")
    facts = common.stored(ownership(values))
    known = common.join_facts(values.select("row", "start", "kind", "end", "hash", "plain"), facts, "hash", "times")
    is_copied = copied(F.col("owners"), F.col("repositories"))
    live = ~is_copied & ~F.col("plain")
    added = F.when(live & (F.col("kind") == KINDS.index("token")), F.struct("start", "kind", "end"))
    # a row's own occurrences
    found = known.groupBy(F.col("row").alias("f_row")).agg(
        F.collect_list(added).alias("added"), F.count_if(live).alias("n_live"), F.count_if(is_copied).alias("n_copied"))
    spans = F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))
    zero = F.lit(0).cast("long")
    return rows.join(found, F.col("row") == F.col("f_row"), "left").select(
        "doc_id", "base", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
        _listing(F.col("base")).alias("base_listing"), _listing(spans).alias("listing"))


def scan_query(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts of the base kinds, their digest, and all spans."""
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scan(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("base_listing", 256).alias("base_sha256"),
                             F.col("listing").alias("spans"), "n_live", "n_copied")
