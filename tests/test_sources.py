"""Sources, extraction, tables, streaming and scalar functions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import runtime
from lattica.functions import scalars as S
from lattica.operators import fuse, reports, text
from lattica.plans import views
from lattica.sources import extract, files, tables
from lattica.streaming import jobs

PY = '''import os
from .base import Base


class Cache(Base):
    def get(self, key, *rest):
        return self.load(key)

    def load(self, key):
        return os.path.join(key)


def use(c: Cache):
    helper(1)
    return c.get("x")


def helper(n):
    return helper(n)
'''


def test_python_extraction_and_resolution(spark):
    rows = spark.createDataFrame([("a/m.py", PY), ("b/bad.py", "def ("), ("c/n.rs", "pub fn run(x: i32) {\n  go(x);\n}\nfn go(y: i32) {\n}\n"), ("d/none.py", None)], "path string, text string")
    nodes, edges = extract.build(rows)
    n = {r.id: r for r in nodes.collect()}
    assert set(n) == {"a/m.py", "a/m.py#Cache", "a/m.py#Cache.get", "a/m.py#Cache.load", "a/m.py#use", "a/m.py#helper", "b/bad.py", "c/n.rs", "c/n.rs#run", "c/n.rs#go"}
    get = n["a/m.py#Cache.get"]
    assert (get.kind, get.owner, get.start_line, get.end_line, get.arity, get.variadic) == ("method", "Cache", 6, 7, 1, True)
    e = {(r.source, r.relation, r.target) for r in edges.collect()}
    assert ("a/m.py#Cache", "extends", "Base") in e
    assert ("a/m.py#Cache.get", "calls", "a/m.py#Cache.load") in e
    assert ("a/m.py#use", "calls", "a/m.py#Cache.get") in e and ("a/m.py#use", "calls", "a/m.py#helper") in e
    assert ("a/m.py#helper", "calls", "a/m.py#helper") in e
    assert ("c/n.rs#run", "calls", "c/n.rs#go") in e
    assert not any(t == "join" or t == "path" for _, r, t in e if r == "calls")
    assert ("a/m.py", "imports", "os") in e and ("a/m.py", "contains", "a/m.py#Cache") in e


def _one_part(spark, n):
    return spark.range(0, n, 1, 1).selectExpr("concat('p', id, '.py') path", "concat('def f', id, '(x):\\n    return f', id div 2, '(x)\\n') text")


def test_files_of_one_part_are_parsed_on_all_cores(spark):
    for rows in extract.extract(_one_part(spark, 40)):
        held = rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert held > 1 and rows.count() == 80


def test_build_parses_each_file_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(extract, "stored", lambda df: kept.append(df) or runtime.stored(df))
    nodes, edges = extract.build(_one_part(spark, 6))
    assert len(kept) == 1 and nodes.count() == 12
    assert sum(r.relation == "calls" for r in edges.collect()) == 6


def test_small_files_share_a_batch(spark):
    seen = {}

    class Files:  # keeps the function that Spark would be given
        sparkSession = spark
        where = select = repartition = lambda self, *a: self
        mapInArrow = lambda self, f, ddl: seen.setdefault("f", f)

    parse = extract._rows(Files(), ("nodes", extract.NODE), ("edges", extract.EDGE))
    made = [pa.RecordBatch.from_pydict({"path": [f"p{i}.py"], "text": [f"def f{i}(): pass"]}) for i in range(30)]
    got = list(parse(iter(made)))
    assert len(got) == 1 and got[0].num_rows == 90
    assert sum(v is not None for v in got[0].column("nodes").to_pylist()) == 60
    assert list(parse(iter([]))) == []


def test_ids_are_minted_in_order():
    rows = extract.extract_file("x.py", "def f(): pass\ndef f(): pass\n")
    assert [r["id"] for r in rows.nodes] == ["x.py", "x.py#f", "x.py#f~2"]


def test_scan_and_drift(spark, tmp_path):
    for path, data in {"src/a.py": b"x = 1\n", "src/u16.ts": "\ufeffhi".encode("utf-16-le"), "src/be.ts": b"\xfe\xff\x00h", "node_modules/z.js": b"no", ".git/c.py": b"no", "big.py": b"x" * 1_000_001, "notes.txt": b"t"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = files.scan(spark, str(tmp_path)).cache()
    assert {r.path: r.text for r in got.collect()} == {"src/a.py": "x = 1\n", "src/u16.ts": "hi", "src/be.ts": None, "notes.txt": "t"}
    assert {(r.path, r.language) for r in files.source_files(got).collect()} == {("src/a.py", "python"), ("src/u16.ts", "typescript"), ("src/be.ts", "typescript")}
    assert [(r.extension, r.files) for r in files.unsupported(got).collect()] == [(".txt", 1)]
    now = got.withColumn("hash", F.when(F.col("path") == "notes.txt", "other").otherwise(F.col("hash"))).withColumn("mtime_ms", F.col("mtime_ms") + 1)
    assert {(r.path, r.drift) for r in files.drift(got.where("path <> 'src/a.py'"), now.where("path <> 'src/be.ts'")).collect()} == {("src/a.py", "added"), ("src/be.ts", "removed"), ("notes.txt", "changed")}


def test_diffs(spark):
    assert list(files.parse_statuses("M\0a.py\0R090\0old.py\0new.py\0D\0gone.py\0")) == [("a.py", "modified", None), ("new.py", "renamed", "old.py"), ("gone.py", "deleted", None)]
    patch = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@ def f\n-x\n+y\n+z\n@@ -9,2 +10,0 @@\n-p\n-q\ndiff --git a/g b/g\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x"
    got = [(r.path, r.start, r.end, r.lines) for r in files.changed_ranges(spark.createDataFrame([(patch,), (None,)], "patch string")).collect()]
    assert got == [("a.py", 1, 2, ["-x", "+y", "+z"]), ("a.py", 10, 10, ["-p", "-q"])]


def test_concepts_round_trip(spark):
    row = {"slug": "rank", "name": "Rank: fusion", "type": "concept", "summary": "Two\nlines", "sources": [{"path": "a", "hash": "b"}], "sources_digest": "d", "links": [], "human": "mine"}
    old = tables.read_concepts(spark.createDataFrame([("x.md", tables.render_concept(row)), ("y.md", "no front matter")], "path string, text string"))
    assert [r.asDict(True) for r in old.collect()] == [row]
    new = old.withColumn("human", F.lit("default")).withColumn("summary", F.lit("fresh"))
    merged = tables.merged_concepts(new, old).first()
    assert (merged.summary, merged.human) == ("fresh", "mine")


def test_graph_and_cards_on_disk(spark, tmp_path):
    nodes, edges = extract.build(spark.createDataFrame([("a/m.py", PY)], "path string, text string"))
    tables.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == nodes.count() and e.count() == edges.count()
    wanted = tables.cards(n, e)
    assert [r.path for r in tables.write_cards(wanted, str(tmp_path / "cards")).collect()] == ["a/m.py"]
    card = (tmp_path / "cards/a/m.py.md").read_text()
    assert card.index("class Cache") < card.index("def helper") and "L18-L19, in 2" in card
    old = spark.createDataFrame([("a/m.py",), ("z.py",)], "path string")
    assert [r.path for r in tables.stale(old, wanted).collect()] == ["z.py"]


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"meta": {"version": 1},\n "nodes": [{"id": "a", "name": "a", "kind": "file", "path": "a", "span": "L1-L9"}],\n "edges": [{"source": "a", "target": "b", "relation": "imports", "confidence": "extracted"}]}')
    n, e = tables.read_graph_json(spark, str(tmp_path / "g.json"))
    assert (n.first().start_line, n.first().end_line) == (1, 9) and e.first().target == "b"


def test_streaming_sessions_equal_batch(spark, tmp_path, sf):
    events = views.table(spark, sf, "events").where("user_id < 40")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    s = jobs.closed_sessions(stream).writeStream.format("memory").queryName("closed2").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    s.awaitTermination()
    from lattica.operators.state import sessions

    whole = {(r.user_id, r.opened, r.events) for r in sessions(events, "2 hours").collect()}
    closed = {(r.user_id, r.opened, r.events) for r in spark.table("closed2").collect()}
    assert closed <= whole and len(closed) > 0.9 * len(whole)


def test_streaming_upkeep(spark, tmp_path):
    batch = spark.createDataFrame([("a.py", 1, 1.0, "h1", "def f(): pass"), ("b.py", 1, 1.0, "h2", "def g(): pass")], "path string, size long, mtime_ms double, hash string, text string")
    batch.write.parquet(str(tmp_path / "in"))
    run = lambda: jobs.upkeep(jobs.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "memo"), str(tmp_path / "cp"), lambda b: extract.extract(b)[0]).awaitTermination()
    run()
    batch.limit(1).withColumn("hash", F.lit("h3")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "memo")).groupBy("epoch").count().collect()
    assert sorted((r["epoch"], r["count"]) for r in got) == [(0, 4), (1, 2)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.tokens(F.lit("getHTTPServer parse_url the Foo2Bar"))) == ["httpserver", "parse", "url", "foo2", "bar"]
    assert one(S.slug(F.lit("  Rank & Fuse! "))) == "rank-fuse" and one(S.slug(F.lit("§"))) == "node"
    assert one(S.clean_signature(F.lit("def  f(x) :"))) == "def f(x)"
    assert [one(S.is_test_for_rank(F.lit(p))) for p in ("src/a.test.ts", "pkg/x_test.go", "conftest.py", "src/latest/a.ts")] == [True, True, True, False]
    assert [one(S.is_test_for_report(F.lit(p))) for p in ("specs/a.rb", "x_test.rb", "conftest.py")] == [True, True, False]
    assert one(S.version_key(F.lit("v1.10.2-rc"))) == [1, 10, 2]
    assert one(S.normal_prefix(F.lit("./a\\b//"))) == "a/b"
    assert one(S.prefixed_pointers(F.lit("api"), F.lit("a:1, b:2"))) == "api/a:1, api/b:2"
    assert one(S.languages_value(F.array(*map(F.lit, ["go", "Bad Name", "c", "go"])))) == ["c", "go"]
    assert [one(S.files_bucket(F.lit(n))) for n in (0, 49, 50, 5000)] == ["0", "1-49", "50-199", "5000+"]
    assert [one(S.saved_tokens_bucket(F.lit(n))) for n in (0, 999, 100_000)] == ["0", "<1k", "100k+"]


def test_reports():
    assert reports.short_label("Concept: Incremental Build via Content Hashes") == "Incremental Build"
    assert reports.short_label("x" * 40) == "x" * 30 + "…"
    assert reports.depth_of("all", 1) is None and reports.depth_of("2.9", 1) == 2 and reports.depth_of(None, 1) == 1
    with pytest.raises(ValueError):
        reports.depth_of("0", 1)
    assert [reports.structural_intent(q) for q in ("who calls f", "Who calls f", "what does f call", "imports and callers", "rank")] == ["in", None, "out", "in", None]
    assert reports.subject_words("who calls Cache.get")[0] == "Cache.get"
    groups = {f"a/b/c{i}/": [str(i)] for i in range(7)} | {"z/": ["z"]}
    small = reports.coarsen(groups, 5)
    assert len(small) <= 5 and sorted(sum(small.values(), [])) == sorted(sum(groups.values(), []))


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([30, 20, 60, 1, 40, 50])], "group string, id long, size long")
    assert {r.id: r.batch for r in reports.greedy_batches(rows, 50).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_fusion_gates(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "id string, scope string, score double")
    two = docs(("h1", "huge", 1.0), ("h2", "huge", 0.5), ("t1", "tiny", 0.9))
    got = {r.id: r.score for r in fuse.reciprocal_rank_fusion(two).collect()}
    assert got["h1"] == got["t1"] == 1 and got["h2"] < 1
    edge = docs(("a", "x", 1.0), ("b", "y", 0.25), ("c", "z", 0.2499))
    assert {r.id for r in fuse.combine_comparable(edge).collect()} == {"a", "b"}
    assert [(r.scope, r.best_id) for r in fuse.weak_scopes(edge).collect()] == [("z", "c")]
    alone = docs(("a", "x", 3.0), ("b", "x", 0.0))
    assert [(r.id, r.score) for r in fuse.combine_comparable(alone).collect()] == [("a", 3.0)]


def test_tests_rank_lower_unless_asked_for(spark):
    docs = spark.createDataFrame([("a", "download stall", "src/a.py", "download stall"), ("b", "download stall", "tests/a.py", "download stall")], "id string, name string, path string, body string")
    s = {r.id: r.score for r in text.lexical_rank(docs, "download stall").collect()}
    assert s["b"] == pytest.approx(0.35 * s["a"])
    t = {r.id: r.score for r in text.lexical_rank(docs, "download stall tests").collect()}
    assert t["b"] > t["a"]
