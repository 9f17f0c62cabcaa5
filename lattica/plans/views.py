"""Graph and corpus views of the driver tables, in Spark and, for the oracles, as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_sql = [
        ("region", "concat('region/', r_regionkey) id, r_name name, 'module' kind, concat('region/', r_regionkey) path"),
        ("nation", "concat('nation/', n_nationkey) id, n_name name, 'class' kind, concat('region/', n_regionkey, '/nation/', n_nationkey) path"),
        ("customer", "concat('customer/', c_custkey) id, c_name name, 'struct' kind, concat('nation/', c_nationkey, '/customer/', c_custkey) path"),
        ("supplier", "concat('supplier/', s_suppkey) id, s_name name, 'interface' kind, concat('nation/', s_nationkey, '/supplier/', s_suppkey) path"),
        ("part", "concat('part/', p_partkey) id, p_name name, 'function' kind, concat('part/', p_brand, '/', p_partkey) path"),
        ("orders", "concat('order/', o_orderkey) id, o_orderpriority name, 'method' kind, concat('customer/', o_custkey, '/order/', o_orderkey) path"),
    ]
    out = None
    for name, columns in spark_sql:
        one = table(spark, sf_dir, name).selectExpr(*[c.strip() for c in _split(columns)])
        out = one if out is None else out.unionByName(one)
    return out


def _split(columns: str) -> list[str]:
    out, depth, own = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += ch
    return [*out, own]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("nation").selectExpr("concat('region/', n_regionkey) source", "concat('nation/', n_nationkey) target", "'contains' relation"),
        t("customer").selectExpr("concat('customer/', c_custkey) source", "concat('nation/', c_nationkey) target", "'extends' relation"),
        t("supplier").selectExpr("concat('supplier/', s_suppkey) source", "concat('nation/', s_nationkey) target", "'implements' relation"),
        t("orders").selectExpr("concat('order/', o_orderkey) source", "concat('customer/', o_custkey) target", "'references' relation"),
        t("lineitem").select("l_orderkey", "l_partkey").distinct().selectExpr("concat('order/', l_orderkey) source", "concat('part/', l_partkey) target", "'calls' relation"),
        t("lineitem").select("l_partkey", "l_suppkey").distinct().selectExpr("concat('part/', l_partkey) source", "concat('supplier/', l_suppkey) target", "'imports' relation"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("confidence", F.lit("extracted"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id id", "substring(text, 1, 40) name", "concat(lang, '/', source, '/', doc_id) path", "text body", "lang scope")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat(lang, '/', source, '/', doc_id) path", "doc_id", "posexplode(split(text, '\\n')) as (i, text)").selectExpr("path", "doc_id", "i + 1 line", "text")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-document span and inner ones of three lines each."""
    size = table(spark, sf_dir, "documents").selectExpr("concat(lang, '/', source, '/', doc_id) path", "size(split(text, '\\n')) n")
    outer = size.selectExpr("path", "concat(path, '#all') id", "1 start_line", "n end_line", "0 ord")
    inner = size.selectExpr("path", "n", "explode(sequence(0, (n - 1) div 3)) k").selectExpr("path", "concat(path, '#', k) id", "3 * k + 1 start_line", "least(3 * k + 3, n) end_line", "k + 1 ord")
    return outer.unionByName(inner)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path")


NODES = """nodes AS (
  SELECT 'region/' || r_regionkey AS id, r_name AS name, 'module' AS kind, 'region/' || r_regionkey AS path FROM region
  UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'class', 'region/' || n_regionkey || '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, c_name, 'struct', 'nation/' || c_nationkey || '/customer/' || c_custkey FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'interface', 'nation/' || s_nationkey || '/supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, p_name, 'function', 'part/' || p_brand || '/' || p_partkey FROM part
  UNION ALL SELECT 'order/' || o_orderkey, o_orderpriority, 'method', 'customer/' || o_custkey || '/order/' || o_orderkey FROM orders)"""
EDGES = """edges AS (
  SELECT 'region/' || n_regionkey AS source, 'nation/' || n_nationkey AS target, 'contains' AS relation FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'extends' FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'implements' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'references' FROM orders
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'supplier/' || l_suppkey, 'imports' FROM lineitem)"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower(regexp_replace({text}, '([0-9a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND t NOT IN ({_STOPS}))"
    )


CORPUS = "corpus AS (SELECT doc_id AS id, substr(text, 1, 40) AS name, lang || '/' || source || '/' || doc_id AS path, text AS body, lang AS scope FROM documents)"
BAGS = f"""{CORPUS}, bags AS (
  SELECT id, field, token, count(*)::INTEGER AS tf FROM (
    SELECT id, 'name' AS field, unnest({sql_tokens('name')}) AS token FROM corpus
    UNION ALL SELECT id, 'path', unnest({sql_tokens('path')}) FROM corpus
    UNION ALL SELECT id, 'body', unnest({sql_tokens('body')}) FROM corpus) GROUP BY ALL),
df AS (SELECT token, count(DISTINCT id) AS df FROM bags GROUP BY token),
stats AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(tf) FROM bags WHERE field = 'body') / (SELECT count(*) FROM corpus) AS avgdl)"""
LINES = """lines AS (
  SELECT path, doc_id, i AS line, parts[i] AS text FROM (
    SELECT lang || '/' || source || '/' || doc_id AS path, doc_id, string_split(text, chr(10)) AS parts,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
SPANS = """sizes AS (SELECT lang || '/' || source || '/' || doc_id AS path, len(string_split(text, chr(10))) AS n FROM documents),
spans AS (
  SELECT path, path || '#all' AS id, 1 AS start_line, n AS end_line, 0 AS ord FROM sizes
  UNION ALL SELECT path, path || '#' || k, 3 * k + 1, least(3 * k + 3, n), k + 1 FROM (SELECT path, n, unnest(range(0, (n - 1) // 3 + 1)) AS k FROM sizes))"""
PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
