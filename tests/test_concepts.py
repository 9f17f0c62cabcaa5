"""Concept operators on small inputs: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from lattica.operators import concepts as C
from lattica.operators import reports


def test_one_liner_and_names(spark):
    df = spark.createDataFrame([(" first \nsecond", "sig"), ("  \n", " sig "), (None, None)], "s string, g string")
    assert [r.x for r in df.select(C.one_liner(F.col("s"), F.col("g")).alias("x")).collect()] == ["first", "sig", ""]
    raw = spark.createDataFrame([("a\r\n<b>|`c`  #(d)",), (None,), ("word " * 20,)], "raw string")
    got = [r.x for r in raw.select(C.sanitized(F.col("raw")).alias("x")).collect()]
    assert got[0] == "a bc d" and got[1] is None and len(got[2]) <= 31


def test_generated_summary(spark):
    body = "x<!--a-->\n## Summary\n" + "y" * 700 + "<!--b-->z"
    df = spark.createDataFrame([(body,), ("no markers ",), ("b<!--b--> a<!--a-->",), (None,)], "b string")
    got = [r.x for r in df.select(C.generated_summary(F.col("b"), "<!--a-->", "<!--b-->").alias("x")).collect()]
    assert got == ["y" * C.SUMMARY_CHARS + "…", "no markers", "b<!--b--> a<!--a-->", None]


def test_roots_and_lists(spark):
    starts = spark.createDataFrame([("a/b/c",), ("a/b/c",), ("x",), ("a/b",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("a/b",), ("q",)], "dir string")
    assert {r.path: (r.root, r.levels) for r in C.nearest_root(starts, roots).collect()} == {"a/b/c": ("a/b", 1), "x": ("x", 0), "a/b": ("a/b", 0)}
    assert C.nearest_root(starts.limit(0), roots).count() == 0
    nodes = spark.createDataFrame([("t", "t", "p/t.py"), *[(f"s{i}", f"n{i}", f"p/s{i}.py") for i in range(10)], ("t2", "t2", "p/t.py")], "id string, name string, path string")
    edges = spark.createDataFrame([(f"s{i}", "t", "calls") for i in range(10)] + [("t2", "t", "calls"), ("gone", "t", "calls")], "source string, target string, relation string")
    row = C.edit_blast(nodes, edges).first()
    assert row.dependents == 11 and row.list.split("\n")[0] == "calls <- gone" and row.list.endswith("+3 more")
    points = spark.createDataFrame([("p", 5), ("p", 99)], "path string, line int")
    spans = spark.createDataFrame([("p", "big", 1, 9, 0), ("p", "one", 4, 6, 1), ("p", "two", 5, 7, 2)], "path string, id string, start_line int, end_line int, ord int")
    assert {r.line: r.symbol for r in C.enclosing_definition(points, spans).collect()} == {5: "one", 99: None}


def test_greedy_batches_walk(spark):
    rows = [("a", i, s) for i, s in enumerate([5, 5, 1, 20, 2, None, 9])] + [(None, 1, 3)]
    got = reports.greedy_batches(spark.createDataFrame(rows, "`group` string, id long, size long"), 10)
    assert {(r["group"], r.id): r.batch for r in got.collect()} == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("a", 5): 3, ("a", 6): 4, (None, 1): 0}
    assert reports.greedy_batches(spark.createDataFrame([], "`group` string, id long, size long")).count() == 0
