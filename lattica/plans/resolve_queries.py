"""Resolution queries over part names, page paths and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import joins, reports, resolve
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


_R = """raw AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'file/' || l_suppkey % 50 AS file, 'sym' || l_partkey % 3000 AS name FROM lineitem WHERE l_orderkey % 8 = 0),
sym AS (SELECT 'part/' || p_partkey AS id, 'sym' || CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 100 ELSE p_partkey END AS name, 'file/' || p_partkey % 50 AS file, p_partkey AS pos FROM part)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = V.table(spark, sf_dir, "lineitem").where("l_orderkey % 8 = 0").selectExpr("l_orderkey * 10 + l_linenumber ord", "concat('file/', l_suppkey % 50) file", "concat('sym', l_partkey % 3000) name")
    sym = V.table(spark, sf_dir, "part").selectExpr("concat('part/', p_partkey) id", "concat('sym', if(p_partkey % 7 = 0, p_partkey % 100, p_partkey)) name", "concat('file/', p_partkey % 50) file", "p_partkey pos")
    return raw, sym


@query("unique_name_resolve", f"""WITH {_R}, loc AS (SELECT r.ord, arg_min(s.id, s.pos) AS t FROM raw r JOIN sym s ON s.name = r.name AND s.file = r.file GROUP BY r.ord),
one AS (SELECT name, min(id) AS t FROM sym GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT DISTINCT r.ord, coalesce(loc.t, one.t) AS target, CASE WHEN loc.t IS NOT NULL THEN 'extracted' ELSE 'inferred' END AS confidence
FROM raw r LEFT JOIN loc USING (ord) LEFT JOIN one ON one.name = r.name WHERE loc.t IS NOT NULL OR one.t IS NOT NULL""")
def unique_name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_names(*_raw(spark, sf_dir)).distinct()


@query("first_candidate_import", """WITH f AS (SELECT 'src/' || p_partkey % 500 || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.js' END AS id FROM part),
w AS (SELECT o_orderkey AS ord, 'src/' || o_custkey % 700 AS base FROM orders),
e(e, p) AS (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.mjs', 5), ('.cjs', 6), ('.py', 7), ('.go', 8), ('.java', 9), ('/index.ts', 10), ('/index.tsx', 11), ('/index.js', 12))
SELECT ord, arg_min(base || e, p) AS target FROM w, e WHERE base || e IN (SELECT id FROM f) GROUP BY ord""")
def first_candidate_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.table(spark, sf_dir, "part").selectExpr("concat('src/', p_partkey % 500, CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.js' END) id")
    raw = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey ord", "concat('./', o_custkey % 700) specifier", "concat('src/', o_orderkey, '.ts') file")
    return resolve.resolve_imports(raw, files)


_TAILS = """files AS (SELECT DISTINCT path AS id FROM paths), tails AS (SELECT id, array_to_string(parts[k:], '/') AS tail FROM (SELECT id, string_split(id, '/') AS parts, unnest(range(1, len(string_split(id, '/')) + 1)) AS k FROM files)),
held AS (SELECT tail, count(*) AS n, min(id) AS one FROM tails GROUP BY tail)"""


@query("suffix_unique_import", f"""WITH {V.PATHS}, {_TAILS} SELECT page_id, one AS target FROM (SELECT page_id, array_to_string(string_split(path, '/')[2:], '/') AS want FROM paths) JOIN held ON tail = want WHERE n = 1""")
def suffix_unique_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paths(spark, sf_dir)
    wanted = p.selectExpr("page_id", "array_join(slice(split(path, '/'), 2, 99), '/') want")
    return resolve.unique_suffix(wanted, ["page_id"], "want", p.select(F.col("path").alias("id")).distinct())


@query("longest_unique_tail", f"""WITH {V.PATHS}, {_TAILS}, want AS (SELECT page_id, 'vendor/x/' || array_to_string(string_split(path, '/')[2:], '/') AS w FROM paths),
tried AS (SELECT page_id, k, array_to_string(parts[k:], '/') AS tail FROM (SELECT page_id, string_split(w, '/') AS parts, unnest(range(1, len(string_split(w, '/')) + 1)) AS k FROM want)),
best AS (SELECT page_id, arg_min(n, k) AS n, arg_min(one, k) AS target FROM tried JOIN held USING (tail) GROUP BY page_id)
SELECT page_id, target FROM best WHERE n = 1""")
def longest_unique_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paths(spark, sf_dir)
    wanted = p.selectExpr("page_id", "concat('vendor/x/', array_join(slice(split(path, '/'), 2, 99), '/')) w")
    return resolve.longest_unique_tail(wanted, ["page_id"], "w", p.select(F.col("path").alias("id")).distinct())


_H = "h AS (SELECT DISTINCT 'T' || c_custkey AS type, 'T' || c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0)"


@query("ancestor_chain3", f"""WITH {_H}, a AS (SELECT type, parent AS ancestor, 1 AS depth FROM h WHERE type <> parent
  UNION SELECT x.type, y.parent, 2 FROM h x JOIN h y ON y.type = x.parent WHERE x.type <> x.parent AND x.type <> y.parent
  UNION SELECT x.type, z.parent, 3 FROM h x JOIN h y ON y.type = x.parent JOIN h z ON z.type = y.parent WHERE x.type <> x.parent AND x.type <> y.parent AND x.type <> z.parent)
SELECT type, ancestor, min(depth) AS depth FROM a GROUP BY type, ancestor""")
def ancestor_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ancestors(V.table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("concat('T', c_custkey) type", "concat('T', c_custkey div 3) parent"))


@query("arity_narrow", """WITH c AS (SELECT l_orderkey AS ord, l_linenumber AS id, (l_orderkey % 5)::INT AS arg_count, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey % 4)::INT END AS arity, l_suppkey % 3 = 0 AS "variadic" FROM lineitem),
f AS (SELECT c.*, arity IS NULL OR CASE WHEN "variadic" THEN arg_count >= arity - 1 ELSE arg_count = arity END AS fits FROM c)
SELECT ord, id, arg_count, arity, "variadic" FROM (SELECT *, max(fits::INT) OVER (PARTITION BY ord) AS any_fit FROM f) WHERE fits OR any_fit = 0""")
def arity_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey ord", "l_linenumber id", "int(l_orderkey % 5) arg_count", "if(l_partkey % 11 = 0, null, int(l_partkey % 4)) arity", "l_suppkey % 3 = 0 variadic")
    return resolve.narrow_by_arity(c)


@query("first_wins_dedup", """SELECT source, relation, target, min(ord) AS ord FROM (SELECT 'order/' || l_orderkey % 200 AS source, 'calls' AS relation, 'part/' || l_partkey % 100 AS target, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY ALL""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "lineitem").selectExpr("concat('order/', l_orderkey % 200) source", "'calls' relation", "concat('part/', l_partkey % 100) target", "l_orderkey * 10 + l_linenumber ord")
    return resolve.first_edges(e)


@query("mint_ordinals", """SELECT path, ord, base || CASE WHEN n = 1 THEN '' ELSE '~' || n END AS id FROM (SELECT p_brand AS path, p_partkey AS ord, p_brand || '#' || split_part(p_name, ' ', 1) AS base,
  row_number() OVER (PARTITION BY p_brand, split_part(p_name, ' ', 1) ORDER BY p_partkey) AS n FROM part)""")
def mint_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "part").selectExpr("p_brand path", "p_partkey ord", "concat(p_brand, '#', split_part(p_name, ' ', 1)) base")
    return resolve.minted(rows).select("path", "ord", "id")


@query("typed_members", f"""WITH {_H}, m AS (SELECT 'T' || s_suppkey % 40 AS owner, 'f' || s_suppkey % 7 AS name, 'S' || s_suppkey AS id FROM supplier),
raw AS (SELECT o_orderkey AS ord, 'T' || o_custkey % 400 AS recv_type, 'f' || o_orderkey % 7 AS name FROM orders),
a AS (SELECT type, parent AS ancestor, 1 AS depth FROM h WHERE type <> parent
  UNION SELECT x.type, y.parent, 2 FROM h x JOIN h y ON y.type = x.parent WHERE x.type <> x.parent AND x.type <> y.parent
  UNION SELECT x.type, z.parent, 3 FROM h x JOIN h y ON y.type = x.parent JOIN h z ON z.type = y.parent WHERE x.type <> x.parent AND x.type <> y.parent AND x.type <> z.parent
  UNION SELECT DISTINCT owner, owner, 0 FROM m),
b AS (SELECT type, ancestor, min(depth) AS depth FROM a GROUP BY ALL),
hit AS (SELECT ord, depth, id, min(depth) OVER (PARTITION BY ord) AS least FROM raw JOIN b ON type = recv_type JOIN m ON owner = ancestor AND m.name = raw.name)
SELECT ord, min(id) AS target FROM hit WHERE depth = least GROUP BY ord HAVING count(DISTINCT id) = 1""")
def typed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = V.table(spark, sf_dir, "supplier").selectExpr("concat('T', s_suppkey % 40) owner", "concat('f', s_suppkey % 7) name", "concat('S', s_suppkey) id")
    raw = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey ord", "concat('T', o_custkey % 400) recv_type", "concat('f', o_orderkey % 7) name")
    heritage = V.table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("concat('T', c_custkey) type", "concat('T', c_custkey div 3) parent")
    return resolve.typed_members(raw, members, heritage)


@query("greedy_batches", f"""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b AS (SELECT source, doc_id, k, 0::BIGINT AS batch, n_chars::BIGINT AS used FROM r WHERE k = 1
  UNION ALL SELECT r.source, r.doc_id, r.k, CASE WHEN used > 0 AND used + n_chars > {reports.BATCH_CHARS} THEN batch + 1 ELSE batch END,
    CASE WHEN used > 0 AND used + n_chars > {reports.BATCH_CHARS} THEN n_chars ELSE used + n_chars END FROM b JOIN r ON r.source = b.source AND r.k = b.k + 1)
SELECT source AS "group", doc_id AS id, batch FROM b""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.greedy_batches(V.table(spark, sf_dir, "documents").selectExpr("source AS `group`", "doc_id id", "n_chars size"))


@query("unique_matches", "SELECT c_custkey, s_suppkey AS target FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey HAVING count(*) = 1) ON c_nationkey = s_nationkey")
def unique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unique_match(V.table(spark, sf_dir, "customer"), ["c_custkey"], "c_nationkey", V.table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")
