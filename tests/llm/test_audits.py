"""Divergence, filter and secret audits against brute force and SQL, on awkward small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenure.llm import common, divergence, filteraudit, secrets

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside, as other columns of the input.
CLASH = ("term", "prefix", "shared", "docs", "n", "total", "kept", "p", "bucket", "part", "mask", "name", "h", "block", "again", "possible", "first", "row", "hash",
         "owner", "repository", "base", "values", "times", "owners", "a.b", "__row")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(seed, n, letters="abcdé"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))) for _ in range(n))


KEY = "sk9QmZ4xT7vLb2Rc8WnJ5d"
ROWS = [
    *[(i, words(i, 25), "en", f"s{i % 3}") for i in range(1, 40)],
    *[(100 + i, words(7, 25), "en", "s0") for i in range(6)],
    (200, None, "en", "s1"), (201, "", None, None), (202, "  \t\n ", "", ""), (203, None, "de", "only"), (204, "Ünïcode " * 3, "de", "only"),
    (None, words(7, 25), "en", "s0"), (None, words(7, 25), "en", "s0"), (None, None, None, None), (7, words(7, 25), "en", "s0"), (7, words(7, 25), "en", "s1"),
    (205, words(3, 250), "en", "s2"), (206, "AAA BB C# " * 90, "fr", "x"), (207, "word " * 300, "fr", "y"), (208, "x" * 5000 + " " + "x" * 5000 + "y", "fr", "x"),
    (209, f"my key {KEY} and password = 'hunter2hunter2' AKIA{'Q7' * 8}", "en", "s0"), (210, f"token:{'ab12' * 6} é {KEY}A 0123456789abcdef0", "en", "s1"),
    *[(300 + i, f"copied {KEY}Zz in token='{KEY}Yy' é {'0f' * 9}", "en", f"s{i % 4}") for i in range(8)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, source, *["?"] * len(CLASH)) for i, t, lang, source in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0, "?"), (1, 0, 1, "?"), (2, 1, 1, "?"), (7, 0, 1, "?"), (7, 0, 1, "?"), (103, 1, 0, "?"), (None, 1, 1, "?"), (206, None, 1, "?")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# divergence

def brute_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_divergence(rows, least, top):
    seen, counts, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = brute_terms(text)
        seen.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in seen.items() if g == lang and n >= least]
        v = len(kept)

        def rates(names):
            n = {t: sum(counts[lang, s, t] for s in names) for t in kept}
            all_n = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (all_n + 5 * v) for t in kept}

        q, p = rates(sources), {s: rates([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, i) for i, (x, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -x, i) for i, (x, _, t) in enumerate(sorted(over)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "top", "cells", "broadcast"), [(3, 50, 500_000, 1_000_000), (2, 4, 20, 0), (1, 50, 50, 1_000_000), (1000, 50, 50, 0)])
def test_divergence(docs, monkeypatch, least, top, cells, broadcast):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", broadcast)
    assert rows_of(divergence.divergence(docs, min_docs=least, top=top)) == brute_divergence(ROWS, least, top)


def test_divergence_of_nothing(docs):
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_prefixes_below_the_threshold_are_not_extended(spark, docs):
    """Counts of prefixes are distinct documents, and every level keeps exactly the frequent ones."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = common.written(divergence.term_rows(named))
    for length in (1, 2, 3, 4):
        got = {(r.lang, bytes(r.prefix)): r.docs for r in rows.where(F.col("shared") < length).groupBy("lang", divergence._prefix(length).alias("prefix"))
               .agg(F.sum("docs").alias("docs")).collect()}
        want = Counter((lang or "", x) for _, text, lang, _ in ROWS for x in {(t.encode() + b"\0")[:length] for t in brute_terms(text)})
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("lm"), st.sampled_from("st"), st.one_of(st.none(), st.text("abAB1é漢 .", max_size=12))), min_size=1, max_size=6),
       st.integers(0, 3), st.booleans())
def test_slices_of_any_batch(rows, skip, small):
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["lang", "source", "text"]).slice(min(skip, len(rows) - 1))
    left = rows[min(skip, len(rows) - 1):]
    before, divergence.SLICE_BYTES = divergence.SLICE_BYTES, 2 if small else divergence.SLICE_BYTES
    try:
        got, docs = Counter(), Counter()
        for out in divergence._by_slices(divergence.occurrences)(iter([batch.slice(i, 1) for i in range(batch.num_rows)])):
            for r in out.to_pylist():
                got[r["lang"], r["source"], r["term"].decode()] += r["n"]
        for out in divergence._by_slices(divergence.document_counts)(iter([batch])):
            for r in out.to_pylist():
                docs[r["lang"], r["term"].decode()] += r["docs"]
    finally:
        divergence.SLICE_BYTES = before
    assert got == Counter((a, b, t) for a, b, x in left for t in brute_terms(x))
    assert docs == Counter((a, t) for a, _, x in left for t in set(brute_terms(x)))


def test_shared_prefixes_of_long_words():
    base = b"q" * 70
    listed = [b"", b"a", base, base + b"a", base + b"b" * 300, base + b"b" * 300 + b"c"]
    array = pa.array(listed, pa.large_binary())
    left, right = np.arange(5), np.arange(1, 6)
    assert divergence.shared_bytes(array, left, right).tolist() == [0, 0, 70, 70, 370]


def test_rates_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**13, 10**7), (0, 10**18, 3)], "n long, total long, kept long")
    got = [r[0] for r in big.select(divergence.rate("n", "total", "kept")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * k) for n, t, k in ((10**12, 10**13, 10**7), (0, 10**18, 3))]


# filters

def brute_audit(rows, labels):
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            gone = set()
            for step, x in enumerate(order, 1):
                removed = [d for d in mine if x in d[0] and not d[0] & gone]
                redundant = sum(x in d[0] and bool(d[0] & gone) for d in mine)
                gone.add(x)
                shapley[part, x] += len(removed)
                out.append((part, "".join(order), step, sum(not d[0] & gone for d in mine), len(removed), redundant, sum(d[0] == {x} for d in mine),
                            sum(d[1] for d in removed), sum(d[2] for d in removed), x))
    return sorted(((*r[:-1], shapley[r[0], r[-1]]) for r in out), key=str)


@pytest.mark.parametrize(("broadcast", "counters"), [(2_000_000, 16), (0, 16), (0, 1)])
def test_filter_audit(docs, labels, monkeypatch, broadcast, counters):
    """Whatever the sketch's size and join, the counts are those of a scan."""
    monkeypatch.setattr(filteraudit, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(filteraudit, "COUNTERS", counters)
    assert rows_of(filteraudit.audit(docs, labels)) == brute_audit(ROWS, [tuple(r) for r in labels.collect()])


def test_filter_audit_of_nothing(docs, labels):
    assert filteraudit.audit(docs.limit(0), labels).collect() == []
    assert rows_of(filteraudit.audit(docs, labels.limit(0))) == brute_audit(ROWS, [])


def test_the_sketch_clears_unique_texts_only(spark):
    rows = spark.range(4000).selectExpr("xxhash64(if(id < 3000, id, id % 10)) AS h", "id < 3000 AS one")
    blocks = 4000 * filteraudit.COUNTERS // filteraudit.BLOCK
    got = filteraudit.with_possible(rows, filteraudit.repeat_sketch(rows, blocks), blocks)
    found = {(r.one, r.possible): r["count"] for r in got.groupBy("one", "possible").count().collect()}
    assert (False, False) not in found and found[True, False] > 2600


# secrets

def brute_secrets(rows):
    low = "password|passwd|secret|token|api_?key"
    found = []
    for i, text, _, source in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end(), m.group(2)) for m in re.finditer(rf"""({low})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 12]
        for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
            spans += [(m.start(), kind, m.end(), m.group()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
        more = [(m.start(), 3, m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9_+=-]+", text)]
        more = [x for x in more if len(x[3]) >= 20 and len(set(x[3])) >= 10 and all(re.search(c, x[3]) for c in ("[a-z]", "[A-Z]", "[0-9]"))
                and not any(s[0] < x[2] and s[2] > x[0] for s in spans)]
        found.append((i, source, sorted(spans), more))
    where = defaultdict(set)
    for i, source, spans, more in found:
        for *_, value in spans + more:
            where[value].add((source, i))
    out = []
    for i, _, spans, more in found:
        copied = {v for *_, v in spans + more if len({s for s, _ in where[v]}) >= 3 and len(where[v]) >= 5}
        live = [x for x in spans + more if x[3] not in copied and not secrets.looks_plain(x[3])]

        def text_of(listed):
            return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(listed))

        n = Counter(k for _, k, *_ in spans)
        out.append((i, n[0], n[1], n[2], hashlib.sha256(text_of(spans).encode()).hexdigest(), text_of(spans + [x for x in live if x[1] == 3]), len(live),
                    sum(x[3] in copied for x in spans + more)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_secrets(docs, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    got = rows_of(secrets.scan_query(docs))
    assert got == brute_secrets(ROWS)
    by_id = {r[0]: r[5] for r in got}
    assert by_id[209].startswith("token:7:29,assign:34") and "access" in by_id[209]
    # a copied example stays out, its base spans stay
    assert "token" not in by_id[300] and "assign" in by_id[300] and "hex" in by_id[300]
    assert secrets.scan_query(docs.limit(0)).collect() == []


def test_hot_values_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.range(60_000).selectExpr("if(id < 40000, 0, id) AS k", "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("times")).withColumn("x", F.col("k") * 2)
    got = common.join_facts(rows, facts.cache(), "k", "times")
    assert got.count() == 60_000 and got.where("x <> 2 * k").isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.text("tokenTOKEN=: \"'abc0129AKIAf", max_size=60))
def test_base_spans(text):
    brute = brute_secrets([(1, text, "", "")])[0]
    base = secrets.base_spans(text)
    listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
    assert hashlib.sha256(listed.encode()).hexdigest() == brute[4]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_audit", "op13_secret_scan"])
def test_sql(spark, docs, labels, name, tmp_path):
    """The registered SQL says the same, on the given tables and on awkward rows."""
    docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for folder, files in ((SF, "{t}.parquet"), (tmp_path, "{t}.parquet/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{files.format(t=t)}'")
        df = entry.queries()[name](spark, str(folder))
        rel = con.sql(entry.oracle_sql()[name])
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
