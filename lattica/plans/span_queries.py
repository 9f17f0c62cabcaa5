"""Span queries: lines to symbols, overlaps, residual lines, scopes by prefix, grep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import joins, reports
from lattica.plans import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


_INNER = "(SELECT arg_max(id, (start_line, ord)) FROM spans s WHERE s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line)"


@query("innermost_span", f"""WITH {V.LINES}, {V.SPANS} SELECT l.path, l.line, arg_max(s.id, (s.start_line, s.ord)) AS symbol
FROM lines l LEFT JOIN spans s ON s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line WHERE l.line % 5 = 0 GROUP BY l.path, l.line""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.lines(spark, sf_dir).where("line % 5 = 0").select("path", "line")
    return joins.innermost_span_join(points, V.spans(spark, sf_dir))


@query("overlap_seeds", f"""WITH {V.SPANS}, r AS (SELECT path, doc_id % 4 + 1 AS a, doc_id % 4 + 2 AS b FROM (SELECT *, lang || '/' || source || '/' || doc_id AS path FROM documents) WHERE doc_id % 3 = 0),
h AS (SELECT DISTINCT s.* FROM spans s JOIN r ON r.path = s.path AND start_line <= b AND end_line >= a)
SELECT path, id FROM h WHERE NOT EXISTS (SELECT 1 FROM h i WHERE i.path = h.path AND i.id <> h.id AND h.start_line <= i.start_line AND h.end_line >= i.end_line)""")
def overlap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = V.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").selectExpr("concat(lang, '/', source, '/', doc_id) path", "doc_id % 4 + 1 start", "doc_id % 4 + 2 end")
    return joins.overlap_innermost(ranges, V.spans(spark, sf_dir))


@query("residual_lines", f"""WITH {V.LINES}, {V.SPANS} SELECT path, count(*) AS lines, substr(trim(regexp_replace(string_agg(text, ' ' ORDER BY line), '\\s+', ' ', 'g')), 1, 16000) AS residual
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = l.path AND s.ord % 2 = 1 AND l.line BETWEEN s.start_line AND s.end_line) GROUP BY path""")
def residual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.residual(V.lines(spark, sf_dir), V.spans(spark, sf_dir).where("ord % 2 = 1"))


_GREP = f"""WITH {V.LINES}, {V.SPANS}, hit AS (SELECT path, line, text FROM lines WHERE regexp_matches(text, '(?i)licensed|token ='))
SELECT path, arg_max_symbol AS symbol, count(*) AS hits, min(line) AS first_line FROM (
  SELECT h.path, h.line, (SELECT arg_max(s.id, (s.start_line, s.ord)) FROM spans s WHERE s.path = h.path AND h.line BETWEEN s.start_line AND s.end_line) AS arg_max_symbol FROM hit h)
GROUP BY path, arg_max_symbol"""


@query("grep_grouped", _GREP)
def grep_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = reports.grep(V.lines(spark, sf_dir), V.spans(spark, sf_dir), "(?i)licensed|token =")
    return hits.groupBy("path", "symbol").agg(F.count("*").alias("hits"), F.min("line").alias("first_line"))


@query("grep_truncated", f"""WITH {V.LINES}, hit AS (SELECT path, line, row_number() OVER (ORDER BY path, line) AS n FROM lines WHERE contains(text, 'the'))
SELECT count(*) FILTER (n <= 300) AS shown, count(*) FILTER (n > 300) AS dropped, count(DISTINCT path) AS files FROM hit""")
def grep_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is a count, so neither the shown nor the dropped lines are ranked on one task."""
    hit = V.lines(spark, sf_dir).where(F.col("text").contains("the"))
    return hit.agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).select(F.least("n", F.lit(300)).alias("shown"), F.greatest(F.col("n") - 300, F.lit(0)).alias("dropped"), "files")


@query("longest_prefix_scope", f"""WITH {V.PATHS}, scopes AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM paths WHERE page_id % 2 = 0
  UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM paths WHERE page_id % 3 = 0)
SELECT page_id, coalesce((SELECT arg_max(prefix, length(prefix)) FROM scopes WHERE path = prefix OR starts_with(path, prefix || '/')), '') AS scope FROM paths""")
def longest_prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paths(spark, sf_dir)
    scopes = p.where("page_id % 2 = 0").select(S.dir_key(F.col("path"), 1).alias("prefix")).union(p.where("page_id % 3 = 0").select(S.dir_key(F.col("path"), 2))).distinct()
    return joins.longest_prefix_join(p, "path", scopes).select("page_id", "scope")


@query("scope_substance_guard", f"""WITH {V.PATHS}, n AS (SELECT split_part(path, '/', 1) AS scope, count(*) AS n FROM paths GROUP BY 1)
SELECT CASE WHEN n < 5 THEN '' ELSE scope END AS scope, sum(n)::BIGINT AS symbols FROM n GROUP BY 1""")
def scope_substance_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.paths(spark, sf_dir).groupBy(S.dir_key(F.col("path"), 1).alias("scope")).agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") < 5, "").otherwise(F.col("scope")).alias("scope")).agg(F.sum("n").alias("symbols"))


@query("path_prefix_filter", f"WITH {V.PATHS} SELECT page_id, path FROM paths WHERE path = 'blog.tionsh.example.com' OR starts_with(path, 'blog.tionsh.example.com/')")
def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paths(spark, sf_dir).where(S.under_prefix(F.col("path"), "blog.tionsh.example.com"))


@query("path_labels", f"""WITH {V.PATHS} SELECT page_id, CASE WHEN instr(path, '/') = 0 THEN '(root)' ELSE regexp_replace(path, '/[^/]*$', '') || '/' END AS dir,
  string_split(path, '/')[-1] AS base, CASE WHEN len(string_split(path, '/')) <= 2 THEN '' ELSE regexp_replace(path, '/[^/]*/[^/]*$', '') || '/' END AS parent FROM paths""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.dir_label(F.col("path"))
    return V.paths(spark, sf_dir).select("page_id", d.alias("dir"), S.base_name(F.col("path")).alias("base"), S.parent_dir(F.when(d == "(root)", "").otherwise(d)).alias("parent"))


@query("span_slices", """SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS code FROM documents""")
def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", S.slice_lines(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


@query("members_in_order", f"WITH {V.SPANS} SELECT path, string_agg(split_part(id, '#', 2) || ':' || start_line, ',' ORDER BY start_line, id) AS members FROM spans GROUP BY path")
def members_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.struct("start_line", "id")
    g = V.spans(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return g.select("path", F.array_join(F.transform("m", lambda x: F.concat(F.split(x["id"], "#")[1], F.lit(":"), x["start_line"])), ",").alias("members"))


@query("turn_spans", """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations)
SELECT conv_id, pair::BIGINT AS pair, min(turn) AS first, max(turn) AS last, sum(n)::BIGINT AS chars FROM t GROUP BY conv_id, pair""")
def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "conversations").withColumn("pair", F.sum(F.expr("int(role = 'user')")).over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.groupBy("conv_id", "pair").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("chars"))
