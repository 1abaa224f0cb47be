"""Tables that operators write between steps: what they hold and when they go."""

from tenure.llm import mixing, quality
from tenure.llm.common import partitions, stored, written, written_so_far
from tenure.session import written_by_key


def test_table_by_key_is_joined_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, float(i)) for i in range(300)], "key long, value float")
    table = written_by_key(rows, "key", partitions(spark))
    assert sorted(map(str, table.collect())) == sorted(map(str, rows.collect())) and table.dtypes == rows.dtypes
    asked = spark.range(60).withColumnRenamed("id", "key").hint("merge").join(table, "key", "left")
    # only the asking side is dealt
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert asked.count() == sum(max(1, sum(i % 50 == k and i % 7 > 0 for i in range(300))) for k in range(60))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_counts_go_before_documents_ask(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 9} of {i % 4}") for i in range(200)], "doc_id long, text string")
    kept = written(quality.count_bigrams(docs))
    whole = {r.rid: r.loss for r in quality.log_perplexities(docs, kept).collect()}
    since = written_so_far()
    grams = written(quality.count_bigrams(docs))
    loss = stored(quality.log_perplexities(docs, grams, since))
    # of what was written, the table that was asked is left
    assert written_so_far() == since + 1
    got = {r.rid: r.loss for r in loss.collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-6 for k in got)
    assert kept.count() > 0


def test_sized_rows_are_a_compressed_table(spark):
    docs = spark.createDataFrame([(i, "a b c", "xy"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    since = written_so_far()
    mixed = mixing.mix(docs)
    assert written_so_far() == since + 1 and mixed.count() == 40
