"""The training-data operators against brute force, on awkward small tables."""

import base64
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tenure.llm import ann, bpe, components, jaccard, langid, mixing, quality, sharding, sql, tokencounts, urlfilter, vectordups

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Columns that operators use inside, as other columns of the input.
CLASH = "size string, slot string, shard string, rid string, key string, path string, set_id string, n string, root string, position string, bucket string, " \
        "label_id string, words string, language string, pred string, vec string, copies string, part string, __x string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def base_text(seed, words=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abdegilnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(words))


ROWS = [
    (1, base_text(1), "en", "a"), (2, base_text(1), "en", "a"), (3, base_text(1) + " one more", "en", "b"), (4, base_text(2), "fr", None),
    (5, None, "en", "a"), (6, "", "en", "b"), (7, "   ", None, "b"), (8, "12 34 !!", "de", "c"), (None, base_text(3), "en", "c"),
    (None, base_text(3), "en", "c"), (None, None, None, None), (9, "short", "en", "a"), (9, "short", "en", "a"), (10, "Short  ", None, "a"),
    (11, base_text(4, 3000), "en", "a"), (12, "é漢字🙂\n\nx", "fr", "d"), (13, base_text(1), None, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lg, s, len(t or ""), *["?"] * 19) for i, t, lg, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# sharding

def test_shards_are_even_and_gapless(spark, docs, none):
    out = sharding.shard_documents(spark, docs, shards=4).toPandas()
    assert len(out) == len(ROWS)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    big = max(len((t or "").encode()) for _, t, *_ in ROWS) + 8
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() == big or sums.max() - sums.min() <= big
    assert sharding.shard_documents(spark, none).count() == 0


def test_map_versions_move_only_what_they_must(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text")
    recs = sharding.records(docs)
    loads = sharding.slot_bytes(spark, recs).cache()
    one = sharding.first_map(loads, 8).cache()
    two = sharding.rebalanced(one, loads, 9).cache()
    a, b = (m.toPandas().set_index("vslot").sort_index() for m in (one, two))
    moved = a["shard"] != b["shard"]
    assert set(b.loc[moved, "shard"]) == {8} and 0 < moved.sum() < 1000
    sums = b.groupby("shard")["bytes"].sum()
    assert len(b) == sharding.SLOTS and sums.max() <= sums.mean() * 1.03
    again = sharding.rebalanced(two, loads, 9).toPandas().set_index("vslot").sort_index()
    assert (again["shard"] == b["shard"]).all() and set(again["version"]) == {3}
    path = str(tmp_path / "map")
    sharding.write_map(one, path)
    sharding.write_map(two, path)
    assert rows_of(sharding.read_map(spark, path), "vslot", "shard") == rows_of(two, "vslot", "shard")
    assert rows_of(sharding.read_map(spark, path, 1), "vslot", "shard") == rows_of(one, "vslot", "shard")


# url filter

def test_url_filter_matches_a_scan_of_the_list(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/en", "https://a.b.example.com/en/?q", "x://example.com/en/#f",
            "http://badexample.com/en/", "http://net/es/1", "http://q.net/es/", "http://q.net", "http://É.net/fr/", "http://a..net/fr/", "http://example.com:80/en/",
            "http://" + "a." * 3000 + "net/es/" + "x/" * 3000, "http://x.org/?u=http://net/es/", "http://net/es/1"]
    pages = spark.createDataFrame([(i, u, "?", "?", "?") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, key string")
    rules = [("block", "net", "/es"), ("allow", "q.net", "/"), ("block", "EXAMPLE.com", "/en/"), ("allow", "www.example.com", ""), ("block", "www.example.com", ""),
             (None, "net", "/fr/"), ("block", None, "/")]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, table).collect()}

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), h + p, v) for v, h, p in (("block", "net", "/es"), ("allow", "q.net", "/"), ("block", "example.com", "/en/"), ("block", "www.example.com", ""))
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    blocks = urlfilter.bloom(keys, 64).collect()
    assert 0 < len(blocks) <= 64
    probe = keys.withColumn("block", urlfilter._block(F.col("key"), 64)).join(spark.createDataFrame(blocks), "block")
    for i, bit in enumerate(urlfilter._bits(F.col("key"))):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    assert probe.count() == 3000


@pytest.mark.parametrize("name", ["op2_url_filter", "op7_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


# mixing

def test_mixing_meets_targets(spark, docs, none):
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(ROWS) and (out["taken"] <= 2 * out["size"]).all()
    per = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), w=("weight", "first"))
    assert (abs(per["taken"] - per["target"]) <= 1).all()
    assert per["target"].sum() == pytest.approx(1.5 * out["size"].sum())
    assert list(per["w"]) == [3, 1, 2, 3, 1]
    assert mixing.mix(none).count() == 0
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken", "position"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, out[key].values.tolist()))


def test_positions_invert_the_schedule(spark):
    u = spark.range(1001).select((F.col("id") / 1000).alias("u"))
    for w, shape in mixing.RATES.items():
        t = [r.t for r in u.select(mixing.position(F.col("u"), F.lit(w)).alias("t")).collect()]
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, mixing.KNOTS, shape)
        done = np.append(0, np.cumsum((rate[1:] + rate[:-1]) / 2))
        assert np.abs(np.interp(t, grid, done / done[-1]) - np.linspace(0, 1, 1001)).max() < 1e-6


def test_epochs_follow_the_mix(spark):
    docs = spark.createDataFrame([(i, base_text(i, 20), "en", "abc"[i % 3], 1, "?", "?") for i in range(300)],
                                 "doc_id long, text string, lang string, source string, n_chars long, position string, __lap2 string")
    out = mixing.epochs(docs)
    assert out.columns == docs.columns
    n = Counter(r.source for r in out.collect())
    assert [n[s] for s in "abc"] == [pytest.approx(x, abs=1) for x in (200, 83, 167)]


# tokens

@pytest.fixture(scope="module")
def tk():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeitnsrh .,'\n\téß漢🙂-\x1c\x85"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_encoding_equals_the_library(tk, enc, text):
    ids = np.frombuffer(enc.ids(text), "<u4").tolist()
    assert ids == tk.encode_ordinary(text)
    assert "".join(bpe.decode(enc.tokens, ids)) == text


def test_long_pieces_and_full_caches(tk, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    small = bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    for text in (base_text(5, 400), base_text(6, 400).replace(" ", ""), "a" * 3000, " " * 500 + "x"):
        assert np.frombuffer(small.ids(text), "<u4").tolist() == tk.encode_ordinary(text)


@given(st.binary(max_size=40), st.integers(1, 5))
def test_stream_splits_no_character(data, step):
    stream = bpe.Utf8Stream()
    out = "".join([stream.feed(data[i:i + step]) for i in range(0, len(data), step)]) + stream.finish()
    assert out == data.decode("utf-8", "replace")


def test_encoded_documents(spark, docs, none, tk):
    out = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True, with_text=True).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = tk.encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, docs, none, tk, rule):
    text = "One two\n\n three. é漢字🙂🙂x\nlast" + base_text(9)
    spans = [("x", 0, 5), ("y", 5, 12), ("z", 20, 24), (None, 24, 40)]
    one = spark.createDataFrame([(1, text, "?", "?")], "doc_id long, text string, section string, start string")
    table = spark.createDataFrame([(1, *s) for s in spans] + [(2, "q", 0, 1), (1, "no", None, 4)], "doc_id long, section string, start int, end int")
    got = {(r.section, r.start): r.n_tokens for r in tokencounts.count(tokencounts.with_sections(one, table), RANKS, public_tokenizers.PATTERN, "sections", rule).collect()}
    want, at, data = defaultdict(float), 0, text.encode()
    for s in spans:
        want[s[0], s[1]] = 0.0
    for i in tk.encode_ordinary(text):
        size = len(tk.decode_single_token_bytes(i))
        first = len(data[:at].decode("utf-8", "ignore"))
        last = next(k for k in range(len(text)) if len(text[:k + 1].encode()) >= at + size)
        at += size
        place = lambda c: next(((n, a) for n, a, b in spans if a <= c < b), (None, None))
        chars = {"first": [first], "last": [last], "split": list(range(first, last + 1))}[rule]
        for c in chars:
            want[place(c)] += 1 / len(chars)
    assert got == pytest.approx({k: v for k, v in want.items() if v or k[1] is not None})
    lines = tokencounts.count(docs, RANKS, public_tokenizers.PATTERN, rule=rule).groupBy().agg(F.sum("n_tokens").alias("n")).first().n
    assert lines == pytest.approx(sum(len(tk.encode_ordinary(t or "")) for _, t, *_ in ROWS))
    assert tokencounts.count(none, RANKS, public_tokenizers.PATTERN).count() == 0


# pairs

def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (103, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 50)]
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}, **{i: 200 for i in range(200, 250)}}


def brute_jaccard(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i]] + [comp[j] for j in near[i]]) for i in range(len(rows))]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    return sorted(((rows[i][0], least[comp[i]], len(near[i])) for i in range(len(rows))), key=str)


def near_copies(seed=3):
    rnd, out = random.Random(seed), []
    shared = base_text(99, 30)
    for g in range(30):
        words = base_text(g + 500, rnd.choice([6, 30, 80, 200])).split()
        for c in range(rnd.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = f"w{rnd.random()}"
            out.append(" ".join(copy) + (" " + shared if g % 3 == 0 else ""))
    words = base_text(777, 120).split()
    for c in range(90):  # more than one block, below
        copy = list(words)
        copy[c] = copy[(7 * c) % 120] = f"v{c}"
        out.append(" ".join(copy))
    return out


def test_jaccard_join(spark, docs, none, monkeypatch):
    got = rows_of(jaccard.join(docs), "doc_id", "class_id", "n_links")
    assert got == brute_jaccard([r[:2] for r in ROWS])
    assert jaccard.join(none).count() == 0
    # small blocks and buckets send the groups through every path
    for name, value in (("SMALL", 4), ("BLOCK", 16), ("BLOCK_SHINGLES", 3000), ("TASK_ROWS", 100)):
        monkeypatch.setattr(jaccard, name, value)
    texts = list(enumerate(near_copies()))
    found = jaccard.join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "class_id", "n_links") == brute_jaccard(texts)


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 11, 12] + [None] * 2)


VECTORS = "vec_id long, embedding array<float>, label int, key string, dim string, n string"


def vectors(spark, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.standard_normal(16).tolist(), int(i % 3)) for i in range(150)]
    for i in range(150, 330):
        base = np.array(rows[i % 20][1])
        rows.append((i, (base + rnd.standard_normal(16) * rnd.choice([0, 0.05, 0.2, 0.35])).tolist(), rows[i % 20][2]))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] * 16, 1), (405, [float("inf")] + [1.0] * 15, 1),
             (406, rows[0][1], None), (407, [1.0, 2.0], 1), (408, [1.0, 2.0], 1), (None, rows[0][1], 0), (500, rows[0][1], 0), (500, rows[0][1], 0)]
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], VECTORS), rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_vector_links(spark, monkeypatch):
    df, rows = vectors(spark)
    ok = [fine(v) and lb is not None for _, v, lb in rows]
    unit = [np.array(v, np.float32).astype(np.float64) if f else None for (_, v, _), f in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
            for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in range(50):
        comp = [min([comp[i]] + [comp[j] for j in near[i]]) for i in range(len(rows))]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], len(near[i]), least[comp[i]], rows[i][0] is not None and rows[i][0] == least[comp[i]]) for i in range(len(rows))), key=str)
    for block in (1024, 8):
        monkeypatch.setattr(vectordups, "BLOCK", block)
        assert rows_of(vectordups.link(df), "vec_id", "n_links", "component_id", "kept") == want
    assert vectordups.link(df.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    df, rows = vectors(spark, 2)
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if fine(v) and i is not None]
    for q, x in usable:
        if q % 20 == 0:
            all_ = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in usable if i != q and len(v) == len(x))[:7]
            assert [i for i, _ in got[q]] == [i for _, i in all_]
            assert [s for _, s in got[q]] == pytest.approx([d for d, _ in all_], rel=1e-12)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# language models

def test_language_probabilities_add_up(spark):
    docs = spark.createDataFrame([("the cat the hat that cat", "en"), ("le chat le chapeau", "fr"), (None, "en"), ("no", None)], "text string, lang string")
    model = langid.load(langid.count(docs, 3).cache(), 3)
    assert model["langs"] == ["en", "fr"]
    letters = sorted(set("the cat hat that") - {" "})
    # after any history in the text, all next characters and the unseen one share the mass
    for stem in ("", "t", "th", "ca"):
        logs = langid.word_scores([stem + c for c in letters], model)[:, 0]
        ends = langid.word_scores([stem] if stem else ["t"], model)[0, 0]
        assert np.isfinite(logs).all() and np.isfinite(ends)
    # brute force interpolated Kneser-Ney, order 3, for one language
    words = Counter("the cat the hat that cat".split())
    raw = [Counter(), Counter(), Counter()]
    for w, c in words.items():
        s = " " + w + " "
        for p in range(1, len(s)):
            for n in range(1, 4):
                if p - n + 1 >= 0:
                    raw[n - 1][s[p - n + 1:p + 1]] += c
    a = [Counter(), Counter(), Counter(raw[2])]
    for n in (1, 2):
        left = Counter(g[1:] for g in raw[n])
        for g, c in raw[n - 1].items():
            a[n - 1][g] = c if n > 1 and g[0] == " " else left[g] or c
    d = []
    for t in a:
        n1, n2 = (sum(1 for v in t.values() if v == k) for k in (1, 2))
        d.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(h, c, n):
        if n == 0:
            return 1 / (len(a[0]) + 1)
        h = h[len(h) - n + 1:] if n > 1 else ""
        total = sum(v for g, v in a[n - 1].items() if g[:-1] == h)
        if not total:
            return p(h[1:], c, n - 1)
        kinds = sum(1 for g in a[n - 1] if g[:-1] == h)
        return max(a[n - 1][h + c] - d[n - 1], 0) / total + d[n - 1] * kinds / total * p(h[1:], c, n - 1)

    def word(w):
        s = " " + w + " "
        return sum(math.log(p(s[max(0, i - 2):i], s[i], min(3, i + 1))) for i in range(1, len(s)))

    probe = ["the", "cat", "hat", "tea", "zz", "thch"]
    assert langid.word_scores(probe, model)[:, 0] == pytest.approx([word(w) for w in probe], rel=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = entry.queries()["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["rejected"].mean() < 0.02
    assert got["score"].between(0, 1).all()


def test_language_of_awkward_documents(spark, docs, none):
    out = langid.identify(docs).collect()
    assert len(out) == len(ROWS)
    assert sum(r.lang_pred == "und" and r.rejected and r.score == 0 for r in out) == 5
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(none).count() == 0
    assert langid.keep_known(docs).columns == docs.columns


def test_foreign_text_is_rejected(spark):
    rows = [(i, base_text(i, 80), "en") for i in range(200)] + [(999, " ".join("".join(random.Random(i).choices("qwxzjkvy", k=9)) for i in range(80)), None)]
    out = {r.doc_id: r.rejected for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out.pop(999) and not any(out.values())


def brute_perplexity(train, texts):
    """Modified Kneser-Ney on the operator's own words, from plain counts."""
    import pyarrow as pa

    def grams(t):
        before, own, _, _ = quality.bigrams(pa.array([t], pa.string()))
        return list(zip(before.tolist(), own.tolist()))

    big = Counter(g for t in train for g in grams(t))
    kinds = Counter(w for _, w in big)

    def discounts(c):
        n = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [x if 0 < x <= i else u for i, (x, u) in enumerate(zip(d, [0, 0.5, 1.0, 1.5]))]

    d2, d1 = discounts(big), discounts(kinds)
    all_kinds = sum(kinds.values())
    spare = sum(d1[min(v, 3)] for v in kinds.values()) / all_kinds / (len(kinds) + 1)
    total, saved = Counter(), defaultdict(float)
    for (v, _), c in big.items():
        total[v] += c
        saved[v] += d2[min(c, 3)]
    out = []
    for t in texts:
        loss = 0.0
        for v, w in grams(t):
            low = (kinds[w] - d1[min(kinds[w], 3)]) / all_kinds + spare
            c = big[v, w]
            loss -= math.log((c - d2[min(c, 3)]) / total[v] + saved[v] / total[v] * low if total[v] else low)
        n = len(grams(t))
        out.append(math.exp(loss / n) if n else None)
    return out


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_perplexity(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "HEAD", head)
    rnd = random.Random(8)
    vocabulary = base_text(50, 40).split()
    train = [" ".join(rnd.choice(vocabulary) for _ in range(50)) + " ." for _ in range(60)]
    texts = train[:3] + ["", base_text(60, 20), vocabulary[0], " ".join(rnd.choice(vocabulary) for _ in range(30)), "!!! ??? !!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = quality.count_bigrams(spark.createDataFrame([(t,) for t in train], "text string")).cache()
    got = {r.rid: r for r in quality.log_perplexities(df, grams).collect()}
    names = [r[0] for r in df.select(F.xxhash64("doc_id", "text")).collect()]
    for name, want in zip(names, brute_perplexity(train, texts)):
        loss = got[name].loss
        assert (loss is None and want is None) or math.exp(loss) == pytest.approx(want, rel=1e-4)


def test_quality_of_awkward_documents(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0, "?") for i in range(1, 14)] + [(None, 1, 0, "?"), (4, None, None, "?")], "doc_id long, quality int, toxic int, words string")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(ROWS)
    assert all(not r.kept and r.perplexity is None for r in out if not r.words)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert sum(r.kept for r in quality.classify(docs, labels.limit(0)).collect()) == sum(bool((t or "").strip()) for _, t, *_ in ROWS)
    assert quality.classify(none, labels).count() == 0


def test_quality_separates_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = got[(got["quality"] == 1) & (got["toxic"] == 0)]
    assert good["kept"].mean() > 0.98 and got[got["quality"] == 0]["kept"].mean() < 0.5


# pipeline

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = Counter(r.text for r in docs.collect())
    assert Counter(r.decoded_sha256 for r in out.collect()) == Counter({hashlib.sha256(t.encode()).hexdigest(): n for t, n in texts.items()})


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert sql.URL_FILTER in entry.oracle_sql().values()
    assert list(itertools.islice(corpus_pipeline.STAGES, 1))[0][0] == "quality"
