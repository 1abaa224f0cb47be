"""The training-data operators do the whole job: nothing is cut, merged or left out."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenure.llm import jaccard, langid, mixing, quality, sharding, sql, tokencounts
from tenure.llm.common import split_words

DISCOUNTS = [0, 0.5, 1.0, 1.5]


def made_words(n, seed=1):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abdegilnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(n)})


def full_kneser_ney(train, texts, vocabulary):
    """Mean loss of texts under modified Kneser-Ney of order 2 on the words themselves; nothing is pruned."""

    def grams(t):
        words = t.lower().split()
        return list(zip([None, *words], words))

    big = Counter(g for t in train for g in grams(t))
    kinds = Counter(w for _, w in big)

    def discounts(c):
        n = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return DISCOUNTS
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [x if 0 < x <= i else u for i, (x, u) in enumerate(zip(d, DISCOUNTS))]

    d2, d1 = discounts(big), discounts(kinds)
    size = vocabulary(kinds)
    every = sum(kinds.values())
    spare = sum(d1[min(v, 3)] for v in kinds.values()) / every / size
    total, saved = Counter(), defaultdict(float)
    for (v, _), c in big.items():
        total[v] += c
        saved[v] += d2[min(c, 3)]
    out = []
    for t in texts:
        loss = 0.0
        for v, w in grams(t):
            low = (kinds[w] - d1[min(kinds[w], 3)]) / every + spare
            c = big[v, w]
            loss -= math.log((c - d2[min(c, 3)]) / total[v] + saved[v] / total[v] * low if total[v] else low)
        out.append(loss / len(grams(t)))
    return out


def losses(spark, train, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = quality.count_bigrams(spark.createDataFrame([(t,) for t in train], "text string")).cache()
    got = {r.rid: r.loss for r in quality.log_perplexities(df, grams).collect()}
    return [got[r[0]] for r in df.select(F.xxhash64("doc_id", "text")).collect()]


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_bigrams_seen_once_count(spark, monkeypatch, head):
    monkeypatch.setattr(quality, "HEAD", head)
    rnd = random.Random(8)
    words = made_words(40)
    train = [" ".join(rnd.choice(words) for _ in range(50)) for _ in range(60)]
    texts = [*train[:3], " ".join(rnd.choice(words) for _ in range(30)), words[0]]
    assert losses(spark, train, texts) == pytest.approx(full_kneser_ney(train, texts, lambda kinds: len(kinds) + 1), rel=1e-5)


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_words_keep_apart(spark, monkeypatch, head):
    # 20,000 words in 2^18 or 2^20 classes would share some
    monkeypatch.setattr(quality, "HEAD", head)
    words = made_words(30_000)[:20_000]
    assert len(words) == 20_000
    rnd = random.Random(3)
    train = [" ".join(rnd.choices(words, k=500)) for _ in range(100)]
    texts = [train[0], " ".join(rnd.choices(words, k=300)), " ".join(made_words(50, seed=9)), *words[:40]]
    assert losses(spark, train, texts) == pytest.approx(full_kneser_ney(train, texts, lambda kinds: len(kinds) + 1), rel=1e-5)


def test_every_row_is_mixed(spark):
    rnd = random.Random(5)
    words = made_words(200)
    text = lambda: " ".join(rnd.choices(words, k=20))
    # a third without an id, a third that share ids, equal rows
    rows = [(None if i % 3 == 0 else i // 30 if i % 3 == 1 else i, text(), "abc"[i // 3 % 3]) for i in range(594)]
    rows += [(None, "same " * 20, "a"), (None, "same " * 20, "a"), (7, "same " * 20, "b"), (7, "same " * 20, "b"), (8, "same " * 20, "c"), (8, "same " * 20, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.epochs(docs)
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    per = Counter(s for (_, _, s), n in got.items() for _ in range(n))
    # 200 documents of each source, 900 readings shared 3 : 1 : 2, at most two of each
    assert [per[s] for s in "abc"] == [pytest.approx(x, abs=1) for x in (400, 500 / 3, 1000 / 3)]
    assert all(got[r] == 2 * n for r, n in Counter(rows).items() if r[2] == "a")
    assert Counter(tuple(r) for r in mixing.epochs(docs.repartition(5)).collect()) == got


def test_one_of_a_class_without_ids(spark):
    words = made_words(400)
    near = [" ".join(words[:100] + [w]) for w in words[200:204]]
    rows = [(None, t) for t in near] + [(3, " ".join(words[100:200])), (3, " ".join(words[100:200] + ["more"])), (None, "other"), (None, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text in near for r in kept) == 1 and sum(r.doc_id == 3 for r in kept) == 1
    assert len(kept) == 4


def test_ngrams_keep_apart(spark):
    # 2^20 classes would merge some of these n-grams
    letters = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices(letters, k=8)) for _ in range(12_000))
    counts = langid.count(spark.createDataFrame([(text, "zh")], "text string, lang string")).cache()
    model = langid.load(counts)
    for n, (keys, values) in enumerate(model["p"][0], 1):
        want = {f"{a}"[i:i + n] for a in (f" {w} " for w in set(text.split())) for i in range(len(a) - n + 1)} - {" "} | ({" "} if n == 1 else set())
        assert len(keys) == len(values) == len(want) and (np.diff(keys) > 0).all()
    # an n-gram that was not seen is not found
    words = ["".join(rnd.choices(letters, k=4)) for _ in range(3000)]
    hashes, back, _, _ = langid.grams(words, 4)
    found, _ = langid._look(model["p"][0][3], hashes[3][back == 4].view(np.int64))
    seen = {w[i:i + 4] for w in text.split() for i in range(5)}
    assert found.sum() == sum(w in seen for w in words)


def test_documents_without_lines_count(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one\n\ntwo"), (None, None)], "doc_id long, text string")
    out = tokencounts.count(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, 2: 1, 3: 3, None: 1})
    assert all(r.section is None and r.start is None and r.n_tokens == 0 for r in out if r.doc_id != 3)


def equal_rows(spark, n=20_000):
    """Rows without an id that share a text, and as many that are apart."""
    same = spark.range(n).selectExpr("cast(null AS long) AS doc_id", "'one text of five words' AS text", "'a' AS source")
    return same.unionByName(spark.range(n).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "'a' AS source"))


def test_equal_rows_spread_over_shards(spark):
    out = sharding.shard_documents(spark, equal_rows(spark)).toPandas()
    assert len(out) == 40_000 and out["doc_id"].isna().sum() == 20_000
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() <= 1.05 * sums.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_sharding_by_a_stored_map(spark, tmp_path):
    docs, path = equal_rows(spark, 2000), str(tmp_path / "map")
    first = sharding.shard_documents(spark, docs, 8, map_path=path).toPandas()
    again = sharding.shard_documents(spark, docs, 9, map_path=path).toPandas()
    assert (first["map_version"] == 1).all() and (again["map_version"] == 1).all() and set(again["shard"]) == set(range(8))
    grown = sharding.shard_documents(spark, docs, 9, map_path=path, rebalance=True).toPandas()
    assert (grown["map_version"] == 2).all() and set(grown["shard"]) == set(range(9))
    sums = grown.groupby("shard")["size"].sum()
    assert sums.max() <= 1.05 * sums.mean()
    one, two = (sharding.read_map(spark, path, v).toPandas().set_index("vslot")["shard"] for v in (1, 2))
    assert 0 < (one != two.reindex(one.index)).sum() < len(one) / 4
    held = sharding.read_map(spark, path, 1).groupBy("shard").sum("bytes").toPandas()["sum(bytes)"]
    assert held.sum() == sums.sum()


def test_equal_rows_spread_over_places_in_the_mix(spark):
    docs = equal_rows(spark)
    rows = mixing.sized(docs)
    assert rows.count() == 40_000 and rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 60
    out = mixing.mix(docs).toPandas()
    assert len(out) == 40_000 and out["taken"].sum() == int(out["target"].iloc[0])
    assert len(out[["start"]].drop_duplicates()) == 40_000 and (out["taken"] <= 2 * out["size"]).all()


def test_mixing_equals_sql_with_equal_rows_and_nulls(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, None, 1, 2, 3, 4]), rnd.choice([None, "", "a b", "c d", "x y z " * 4]), rnd.choice(["p", "q", None])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_query(spark, docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(sql.MIXING).df()
    def counted(df):
        return Counter(tuple(None if x is None or x != x else round(float(x), 6) for x in r)
                       for r in df[["doc_id", "size", "source_size", "target", "taken", "position"]].astype(object).where(lambda d: d.notna(), None).itertuples(index=False))

    assert counted(got) == counted(want)


def test_stages_keep_any_column(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "s", "1", "2", "3", "4", "5"), (1, "a b c d e f", "s", "1", "2", "3", "4", "5"), (2, "g h i j k l", None, "x", "y", "z", "u", "v")],
        "doc_id long, text string, source string, __row string, `a.b` string, row string, rid string, `t``k` string")
    for stage in (jaccard.keep_one, mixing.epochs):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {r["a.b"] for r in out.collect()} == {"2", "y"}
    assert jaccard.keep_one(docs).count() == 2


def test_repeated_rows_bring_their_shingles_once(spark, monkeypatch):
    near = " ".join(made_words(120))
    docs = spark.createDataFrame([(7, near)] * 500 + [(8, near + " more")] * 400 + [(9, "else")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(jaccard, "written", lambda df, real=jaccard.written: seen.append(real(df)) or seen[-1])
    out = Counter(tuple(r) for r in jaccard.join(docs).select("doc_id", "class_id", "n_links").collect())
    assert out == {(7, 7, 899): 500, (8, 7, 899): 400, (9, 9, 0): 1}
    assert [df.count() for df in seen if "shingles" in df.columns] == [2]


def test_a_shared_passage_costs_no_square(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    rnd = random.Random(4)
    words = made_words(3000)
    passage = " ".join(rnd.choices(words, k=80))

    def comparisons(n):
        docs = spark.createDataFrame([(i, passage + " " + " ".join(rnd.choices(words, k=160))) for i in range(n)], "doc_id long, text string").repartition(4)
        seen = []
        monkeypatch.setattr(jaccard, "buckets", lambda *a, real=buckets: seen.append(real(*a)) or seen[-1])
        assert jaccard.join(docs).where("n_links > 0 OR class_id <> doc_id").count() == 0
        return seen[0].groupBy("path").agg((F.count("*") * (F.count("*") - 1)).alias("c")).agg(F.sum("c")).first()[0] or 0

    buckets = jaccard.buckets
    few, many = comparisons(150), comparisons(600)
    assert many <= 5 * max(few, 1000)


def test_large_buckets_are_judged_by_sums():
    a, b = np.full(jaccard.SKETCH, 7, np.uint16).tobytes(), np.full(jaccard.SKETCH, 9, np.uint16).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([5, 3, 5, 5]), pa.array([a, a, b, a]), pa.array([a] * 4)], names=["path", "sketch", "first"])
    # one row for each path of a batch, however many sets the path has
    assert [p.to_pydict() for p in jaccard._beside_first(0.6)(iter([batch]))] == [{"path": [3, 5], "near": [1, 2], "n": [1, 3]}]


def test_quality_takes_little_text_at_a_time(monkeypatch):
    taken, real = [], quality.coded
    monkeypatch.setattr(quality, "coded", lambda texts: taken.append(sum(map(len, texts.to_pylist()))) or real(texts))
    none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
    model = SimpleNamespace(contexts=none, words=none, head=none, unseen=-1.0, open=lambda key: np.zeros(len(key), bool))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["word " * 200_000] * 4)], names=["rid", "text"])
    rows = [r for p in quality._ask(SimpleNamespace(value=model))(iter([batch])) for r in p.to_pylist()]
    assert [(r["rid"], r["words"], r["known"]) for r in rows] == [(i, 200_000, -200_000.0) for i in (1, 2, 3, 4)]
    assert sum(taken) == 4_000_000 and max(taken) <= quality.SLICE_BYTES


def test_several_steps_are_taken_at_once():
    """A set's paths three steps on are those of three single steps, each once."""
    rng = np.random.default_rng(5)
    tokens = np.unique(rng.integers(0, 2**63, 40, np.uint64))
    tops = rng.integers(0, 2**63, 30, np.uint64)

    def after(paths, steps):
        batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([paths.view(np.int64)], pa.list_(pa.int64())), pa.array([tokens.tobytes()])], names=["set_id", "paths", "shingles"])
        (out,) = jaccard._step_on(steps)(iter([batch]))
        assert set(out.column("set_id").to_pylist()) <= {7}
        return out.column("path").to_numpy().view(np.uint64)

    one_by_one = after(after(after(tops, 1), 1), 1)
    at_once = after(np.append(tops, tops), 3)
    assert len(at_once) > 30 and sorted(at_once) == sorted(one_by_one)


def test_near_duplicates_leave_no_tables(spark, monkeypatch):
    """Levels' tables go when the next level is counted, the join's when its rows are kept; shingles are not dealt anew."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    passage = " ".join(f"p{i}" for i in range(8))
    docs = spark.createDataFrame([(i, passage + " " + " ".join(f"w{i}_{j}" for j in range(20))) for i in range(40)], "doc_id long, text string")
    steps, real = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df: steps.append(df) or real(df))
    start = jaccard.written_so_far()
    assert jaccard.keep_one(docs).count() == 40
    assert jaccard.written_so_far() == start
    levels = [df for df in steps if df.columns == ["path", "set_id"]]
    assert 0 < len(levels) < jaccard.DEPTH // 2


def test_words_end_before_the_byte_behind_the_texts():
    """The memory behind the last text belongs to anyone; what it holds joins no separator to a word."""
    data = pa.py_buffer(b"one two " + b"\xbf" * 8)
    texts = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 8], np.int32).tobytes()), data])
    assert split_words(texts).to_pylist() == [["one", "two"]]
    assert split_words(pa.array(["", "  ", " a b ", None])).to_pylist() == [[""], [""], ["a", "b"], None]


@pytest.mark.parametrize("words", [lambda t: langid.words_of(t)[0].to_pylist(), lambda t: len(quality.coded(t)[0]), lambda t: jaccard.shingle_sets(t, 1)[0].tolist()], ids=["langid", "quality", "jaccard"])
def test_words_do_not_depend_on_free_memory(words):
    rnd = random.Random(1)
    for _ in range(1500):
        n = 64 * rnd.randint(1, 30)
        left = [np.full(n + 64 * rnd.randint(0, 2), 0xBF, np.uint8) for _ in range(4)], [pa.allocate_buffer(n + 64) for _ in range(4)]
        del left
        assert words(pa.array(["a" * (n - 1) + " "])) == words(pa.array(["a" * (n - 1)]))
