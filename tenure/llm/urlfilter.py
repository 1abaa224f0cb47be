"""URL filter: a blocked Bloom filter of listed canonical keys, then an exact hash join (native).

A listed entry is a host and a path prefix. It fits a url when the url's host is the listed
host or a subdomain of it and the url's path starts with the listed path; the longest fitting
entry decides. A url's candidate keys are therefore its host suffixes, by label, joined with
the prefixes of its path whose length occurs in the list. A filter block holds 512 bits as eight
64-bit words; a key sets one bit in each word, so a key needs one block. Candidates that
pass are joined with the list on the exact key, which removes the false positives.

Filter blocks and the list are ordinary tables: Spark broadcasts them while their size is below
its threshold and shuffles them beyond it. Work is done once per distinct (host, path).

Defined results: host and path of a null url or one without ``://`` are empty and fit no
entry; entries with a null host, path or verdict are not listed; a repeated entry counts once, and of two
verdicts for one key ``block`` wins; urls that fit no entry are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a listed key takes in the filter.
BITS_PER_KEY = 32
WORDS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to ``/ ? #``, ASCII lower case; then the path up to ``? #``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical_key(host: Column, path: Column) -> Column:
    """Length-prefixed so that no two (host, path) give the same key."""
    return F.concat_ws(":", F.length(host).cast("string"), F.concat(host, path))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).alias("block")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, six hash bits each."""
    h = F.xxhash64(key, F.lit(2))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def listed(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict) with one row per key."""
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    clean = clean.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", canonical_key(F.col("host"), F.col("path")))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocks that hold at least one key."""
    bits = _bits(F.col("key"))
    return keys.select(_block(F.col("key"), blocks), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(
        *[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def candidates(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """Keys of (host, path) rows: host suffixes of up to ``labels`` labels, listed prefix lengths."""
    n = F.least(F.size(F.split("host", r"\.")), F.lit(labels))
    suffix = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == F.size(F.split("host", r"\.")), F.col("host")).otherwise(
        F.array_join(F.slice(F.split("host", r"\."), -k, k), ".")))
    prefix = F.transform(F.filter(F.array(*[F.lit(i) for i in lengths]), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    rows = urls.withColumn("suffix", F.explode(suffix)).withColumn("prefix", F.explode(prefix))
    return rows.withColumn("key", canonical_key(F.col("suffix"), F.col("prefix")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has host, path, verdict. The shape of the list (most labels in a host, the
    distinct path lengths, number of keys) is read first; a url is at most a few thousand
    characters, which bounds the lengths.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    entries = listed(rules)
    shape = entries.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")).first()
    if not shape.n:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    blocks = max(1, shape.n * BITS_PER_KEY // (64 * WORDS))
    probes = candidates(rows.select("host", "path").distinct(), shape.labels, sorted(shape.lengths))
    possible = probes.withColumn("block", _block(F.col("key"), blocks)).join(bloom(entries, blocks), "block")
    hit = None
    for i, bit in enumerate(_bits(F.col("key"))):
        test = F.col(f"w{i}").bitwiseAND(bit) != 0
        hit = test if hit is None else hit & test
    exact = entries.select("key", F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("hl"), F.length("path").alias("pl"))
    fits = possible.where(hit).select("host", "path", "key").join(exact, "key")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.col("hl") + F.col("pl"), "hl", "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


#: The listed entries of the registered query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(verdict, host, path)")
