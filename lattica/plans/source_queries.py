"""Sources over text made from the driver tables: extraction, diffs, concepts, cards, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans import views as V
from lattica.sources import extract, files, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file a part: one function that calls the function of another part."""
    text = "concat('def f', p_partkey, '(x, *rest):\\n    return f', p_partkey div 2, '(x)\\n')"
    return V.table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey, '.py') path", f"{text} text")


@query("extract_symbols", """SELECT 'p' || p_partkey || '.py' AS id, 'file' AS kind, 1 AS start_line, 3 AS end_line, NULL::INTEGER AS arity FROM part
UNION ALL SELECT 'p' || p_partkey || '.py#f' || p_partkey, 'function', 1, 2, 1 FROM part""")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_modules(spark, sf_dir))[0].select("id", "kind", "start_line", "end_line", "arity")


@query("extract_and_resolve", """SELECT 'p' || p_partkey || '.py' AS source, 'p' || p_partkey || '.py#f' || p_partkey AS target, 'contains' AS relation, 'extracted' AS confidence FROM part
UNION ALL SELECT 'p' || a.p_partkey || '.py#f' || a.p_partkey, 'p' || b.p_partkey || '.py#f' || b.p_partkey, 'calls', CASE WHEN a.p_partkey = b.p_partkey THEN 'extracted' ELSE 'inferred' END
FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2""")
def extract_and_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.build(_modules(spark, sf_dir))[1]


@query("diff_hunks", """SELECT 'o' || o_orderkey AS path, (o_orderkey % 50 + 1)::INTEGER AS start, (CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 50 + 1 ELSE o_orderkey % 50 + o_custkey % 4 END)::INTEGER AS "end" FROM orders""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat('o', o_orderkey)"
    patch = f"concat('diff --git a/', {name}, ' b/', {name}, '\\n+++ b/', {name}, '\\n@@ -1 +', o_orderkey % 50 + 1, ',', o_custkey % 4, ' @@\\n+x') patch"
    return files.changed_ranges(V.table(spark, sf_dir, "orders").selectExpr(patch)).select("path", "start", "end")


@query("concept_parse", "SELECT 'n' || n_nationkey AS slug, n_name AS name, 'region ' || n_regionkey AS summary, 1::INTEGER AS sources FROM nation")
def concept_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "'---\\nname: \"', n_name, '\"\\nslug: \"n', n_nationkey, '\"\\nsources: [{\"path\": \"a\", \"hash\": \"b\"}]\\n---\\n'"
    text = f"concat({head}, '{tables.BLOCK_START}\\nregion ', n_regionkey, '\\n{tables.BLOCK_END}\\n') text"
    concepts = tables.read_concepts(V.table(spark, sf_dir, "nation").selectExpr("n_name path", text))
    return concepts.select("slug", "name", "summary", F.size("sources").alias("sources"))


@query("language_totals", """WITH f AS (SELECT 'd/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs' WHEN 3 THEN '.rs' ELSE '.txt' END AS path, p_partkey FROM part)
SELECT CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'rust' ELSE 'none' END AS language, count(*) AS files FROM f GROUP BY 1""")
def language_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.table(spark, sf_dir, "part").selectExpr("concat('d/', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs' WHEN 3 THEN '.rs' ELSE '.txt' END) path")
    return f.groupBy(F.coalesce(files.language(F.col("path"), 2), F.lit("none")).alias("language")).agg(F.count("*").alias("files"))


@query("skipped_paths", """SELECT page_id FROM pages WHERE page_id % 3 = 0""")
def skipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "CASE page_id % 3 WHEN 0 THEN concat('src/', page_id, '/a.py') WHEN 1 THEN concat('src/node_modules/', page_id) ELSE concat('.cache/', page_id) END path"
    return V.table(spark, sf_dir, "pages").selectExpr("page_id", path).where(~files.skipped(F.col("path"))).select("page_id")


@query("cards", """SELECT 'p' || p_partkey || '.py' AS path, '# p' || p_partkey || '.py' || chr(10) || chr(10) || '- `def f' || p_partkey || '(x, *rest)` function L1-L2, in ' ||
  (SELECT count(*) FROM part b WHERE b.p_partkey // 2 = a.p_partkey) || chr(10) AS card FROM part a""")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cards(*extract.build(_modules(spark, sf_dir)))
