"""Concepts, keys, labels, roots and edit-time lists over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import REPORT_TEST_PATH
from lattica.operators import concepts as C
from lattica.plans import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE_SQL[name] = sql
        return run

    return add


_CONCEPTS = """cited AS (
  SELECT 'n' || s_nationkey AS slug, 'nation/' || s_nationkey || '/supplier/' || s_suppkey AS path FROM supplier
  UNION ALL SELECT 'all' || s_suppkey % 3, 'nation/' || s_nationkey || '/supplier/' || s_suppkey FROM supplier)"""


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "concat('nation/', s_nationkey, '/supplier/', s_suppkey) path"
    s = V.table(spark, sf_dir, "supplier")
    cited = s.selectExpr("concat('n', s_nationkey) slug", path).unionByName(s.selectExpr("concat('all', s_suppkey % 3) slug", path))
    return cited.groupBy("slug").agg(F.collect_list("path").alias("sources"))


@query("concepts_by_path", f"WITH {_CONCEPTS} SELECT path, string_agg(slug, ',' ORDER BY slug) AS slugs FROM cited GROUP BY path")
def concepts_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concepts_by_path(_concepts(spark, sf_dir)).select("path", F.array_join("slugs", ",").alias("slugs"))


@query("concept_covers", f"WITH {_CONCEPTS}, {V.NODES} SELECT slug, cited.path, name, kind, length(name)::INTEGER AS start_line, length(name)::INTEGER + 2 AS end_line FROM cited JOIN nodes ON cited.path = nodes.path")
def concept_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = V.nodes(spark, sf_dir).selectExpr("*", "length(name) start_line", "length(name) + 2 end_line")
    return C.covers(_concepts(spark, sf_dir), nodes)


@query("concepts_under_prefix", f"WITH {_CONCEPTS} SELECT DISTINCT slug FROM cited WHERE path = 'nation/1' OR starts_with(path, 'nation/1/')")
def concepts_under_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concepts_under(_concepts(spark, sf_dir), "nation/1").select("slug")


@query("one_liners", r"""SELECT doc_id, coalesce(nullif(regexp_replace(split_part(regexp_replace(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END, '^\s+|\s+$', '', 'g'), chr(10), 1), '^\s+|\s+$', '', 'g'), ''), 'f(' || doc_id || ')') AS line FROM documents""")
def one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.expr("CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END")
    return V.table(spark, sf_dir, "documents").select("doc_id", C.one_liner(summary, F.expr("concat(' f(', doc_id, ') ')")).alias("line"))


@query("generated_summaries", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_name ELSE 'plain ' || n_name END AS summary FROM nation")
def generated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat('head\\n<!-- a -->\\n## Summary\\n\\nabout ', n_name, '\\n\\n## Related\\n- x\\n<!-- b -->\\nbelow')"
    rows = V.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"CASE WHEN n_nationkey % 2 = 0 THEN {made} ELSE concat(' plain ', n_name, '\\n') END body")
    return rows.select("n_nationkey", C.generated_summary(F.col("body"), "<!-- a -->", "<!-- b -->").alias("summary"))


@query("flat_names", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 300), '[\r\n]+', ' ', 'g'), '[<>"''`|(){}\[\]#]', '', 'g'), '\s+', ' ', 'g')) AS name FROM pages""")
def flat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", C.flat_name(F.substring("html", 1, 300)).alias("name"))


@query("batch_keys", "SELECT source, sha256(string_agg(lang || '/' || doc_id || ':' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE sha256(text) END, chr(10) ORDER BY lang || '/' || doc_id || ':' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE sha256(text) END)) AS key FROM documents GROUP BY source")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").selectExpr("source", "concat(lang, '/', doc_id) path", "CASE WHEN doc_id % 7 <> 0 THEN sha2(text, 256) END hash")
    return C.set_keys(rows, "source")


@query("cluster_keys", "SELECT source, substr(sha256(string_agg(lang || '/' || doc_id || ':' || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE sha256(text) END, chr(10) ORDER BY lang || '/' || doc_id || ':' || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE sha256(text) END)), 1, 16) AS key FROM documents GROUP BY source")
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").selectExpr("source", "concat(lang, '/', doc_id) path", "CASE WHEN doc_id % 7 <> 0 THEN sha2(text, 256) END hash")
    return C.set_keys(rows, "source", "?", 16)


@query("test_only_modules", f"SELECT doc_id % 40 AS module, bool_and(regexp_matches(CASE WHEN doc_id % 40 % 3 > 0 THEN 'src/a' || doc_id || '.test.ts' ELSE 'src/a' || doc_id || '.ts' END, '{REPORT_TEST_PATH}')) AS test_only FROM documents GROUP BY 1")
def test_only_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").selectExpr("doc_id % 40 module", "CASE WHEN doc_id % 40 % 3 > 0 THEN concat('src/a', doc_id, '.test.ts') ELSE concat('src/a', doc_id, '.ts') END path")
    return C.test_only(rows, "module")


@query("enclosing_definition", f"""WITH {V.LINES}, {V.SPANS}, p AS (SELECT path, line FROM lines WHERE doc_id % 10 = 0)
SELECT p.path, p.line::INTEGER AS line, arg_min(s.id, (s.end_line - s.start_line) * 100000 + s.ord) AS symbol FROM p LEFT JOIN spans s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY p.path, p.line""")
def enclosing_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.lines(spark, sf_dir).where("doc_id % 10 = 0").select("path", "line")
    return C.enclosing_definition(points, V.spans(spark, sf_dir)).select("path", "line", "symbol")


@query("scope_hit_counts", "SELECT lang AS scope, count(*) AS hits FROM documents WHERE doc_id % 5 = 0 GROUP BY lang")
def scope_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope_counts(V.table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN lang END scope"))


@query("nearest_roots", f"""WITH {V.PATHS}, starts AS (SELECT DISTINCT path FROM paths), roots AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS dir FROM paths WHERE page_id % 4 = 0),
up AS (SELECT path, k, array_to_string(string_split(path, '/')[1:k], '/') AS dir, len(string_split(path, '/')) - k AS levels FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM starts)),
best AS (SELECT path, arg_min(dir, levels) AS root, min(levels)::INTEGER AS levels FROM up JOIN roots USING (dir) GROUP BY path)
SELECT s.path, coalesce(root, s.path) AS root, coalesce(levels, 0) AS levels FROM starts s LEFT JOIN best USING (path)""")
def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = V.paths(spark, sf_dir)
    return C.nearest_root(paths.select("path"), paths.where("page_id % 4 = 0").selectExpr("array_join(slice(split(path, '/'), 1, 2), '/') dir"))


@query("edit_blast_list", f"""WITH {V.NODES}, {V.EDGES}, incoming AS (
  SELECT t.path, e.source, e.relation, e.target, coalesce(s.name || ' (' || regexp_replace(s.path, '^.*/', '') || ')', e.source) AS label
  FROM edges e JOIN nodes t ON t.id = e.target LEFT JOIN nodes s ON s.id = e.source WHERE s.path IS NULL OR s.path <> t.path),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source, relation, target) AS k, count(*) OVER (PARTITION BY path) AS n FROM incoming)
SELECT path, n AS dependents, string_agg(relation || ' <- ' || label, chr(10) ORDER BY k) FILTER (WHERE k <= 8) || CASE WHEN n > 8 THEN chr(10) || '+' || (n - 8) || ' more' ELSE '' END AS list FROM r GROUP BY path, n""")
def edit_blast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edit_blast(V.nodes(spark, sf_dir), V.edges(spark, sf_dir))


@query("pack_savings", "SELECT doc_id, greatest(round(n_chars / 4.0)::BIGINT - 250, 0) AS saved FROM documents")
def pack_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", C.pack_saving(F.lit(1000), F.col("n_chars")).alias("saved"))
