import contextlib
import io
from datetime import datetime

from tenure.operators import clean
from tenure.plans import base


def order_tables(spark, path):
    """Order tables with repeated and null keys in every table and repeated lines."""
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    save("nation", [(1, "A"), (2, "B"), (2, "B"), (None, "C")], "n_nationkey int, n_name string")
    save("customer", [(1, 1), (2, 2), (2, 2), (3, 1), (3, 2), (None, 1)], "c_custkey long, c_nationkey int")
    save("part", [(1, "BOLT"), (2, "NUT"), (2, "NUT"), (3, "PLATE"), (3, "RING"), (4, None), (None, "GEAR")],
         "p_partkey long, p_name string")
    save("orders", [(k, k and (k % 4 or None), datetime(1995 + k % 5, 1 + k % 12, 3)) for k in (*range(1, 130), 13, 20)],
         "o_orderkey long, o_custkey long, o_orderdate timestamp")
    save("lineitem", [(k, p, n, float(q), 10.0 * q, "A" if k and k % 3 else "R")
                      for k in (*range(1, 130), 7, None) for n, p in enumerate((1, 2, 3, 4, 5, None, 1), 1) for q in (2, 0)],
         "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")


def test_lines_are_made_distinct_without_their_description(spark, tmp_path):
    order_tables(spark, tmp_path)
    # the rows are those of the raw lines made distinct whole
    whole = clean.clean(base.raw(spark, str(tmp_path)), outlier="none")
    kept = base.lines(spark, str(tmp_path))
    assert kept.columns == whole.columns and kept.count() > 300
    assert kept.exceptAll(whole).isEmpty() and whole.exceptAll(kept).isEmpty()
    # no text is carried through the step that makes them distinct, and no total is stored
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        base.cleaned(spark, str(tmp_path)).explain(extended=True)
    grouped = [line for line in plan.getvalue().split("Optimized Logical Plan")[1].split("== Physical")[0].splitlines() if "Aggregate [" in line]
    assert any("quantity" in line for line in grouped) and not any("quantity" in line and "p_name" in line for line in grouped)
    assert "line_total" not in spark.read.parquet(list(base._LINES.values())[-1][1]).columns
