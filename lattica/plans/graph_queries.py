"""Graph queries: degrees, neighbours, walks, maps, checks, change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import graph
from lattica.plans import views as V
from lattica.schema import WALK_RELATIONS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_WALK = "(" + ", ".join(f"'{r}'" for r in WALK_RELATIONS) + ")"
_DEG = f"deg AS (SELECT target AS id, count(*) AS in_degree FROM edges WHERE relation IN {_WALK} GROUP BY target)"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


@query("in_degree_all", f"WITH {V.EDGES}, {_DEG} SELECT id, in_degree FROM deg")
def in_degree_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(V.edges(spark, sf_dir))


@query("hotspots_top12", f"WITH {V.NODES}, {V.EDGES}, {_DEG} SELECT name, kind, path, in_degree FROM nodes JOIN deg USING (id) ORDER BY in_degree DESC, name, path LIMIT 12")
def hotspots_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.in_degree(V.edges(spark, sf_dir))
    return V.nodes(spark, sf_dir).join(d, "id").select("name", "kind", "path", "in_degree").orderBy(F.desc("in_degree"), "name", "path").limit(12)


@query("per_dir_hubs_top3", f"""WITH {V.NODES}, {V.EDGES}, {_DEG}
SELECT dir, name, path, in_degree, rank FROM (SELECT split_part(path, '/', 1) AS dir, name, path, in_degree,
  row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY in_degree DESC, name, path) AS rank FROM nodes JOIN deg USING (id)) WHERE rank <= 3""")
def per_dir_hubs_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = V.nodes(spark, sf_dir).join(graph.in_degree(V.edges(spark, sf_dir)), "id").withColumn("dir", S.dir_key(F.col("path"), 1))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("in_degree"), "name", "path"))
    return hubs.withColumn("rank", rank).where("rank <= 3").select("dir", "name", "path", "in_degree", "rank")


@query("callers_depth1", f"WITH {V.NODES}, {V.EDGES} SELECT source AS id, relation, source IN (SELECT id FROM nodes) AS known FROM edges WHERE relation IN {_WALK} AND target IN ('nation/3', 'part/7')")
def callers_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    return graph.neighbours(V.edges(spark, sf_dir), n, n.where("id IN ('nation/3', 'part/7')"), "in")


@query("callees_depth1", f"WITH {V.NODES}, {V.EDGES} SELECT target AS id, relation, target IN (SELECT id FROM nodes) AS known FROM edges WHERE relation IN {_WALK} AND source IN ('order/1', 'order/2', 'part/7')")
def callees_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    return graph.neighbours(V.edges(spark, sf_dir), n, n.where("id IN ('order/1', 'order/2', 'part/7')"), "out")


def _bfs_sql(near: str, far: str, seed: str, depth: int) -> str:
    return f"""WITH RECURSIVE {V.EDGES}, walk AS (SELECT {near} AS near, {far} AS far, relation FROM edges WHERE relation IN {_WALK}),
b(id, d) AS (SELECT '{seed}', 0 UNION SELECT far, d + 1 FROM b JOIN walk ON near = id WHERE d < {depth}),
best AS (SELECT id, min(d) AS depth FROM b GROUP BY id)
SELECT x.id, x.depth, min(relation) AS relation FROM best x JOIN walk ON far = x.id JOIN best y ON y.id = near AND y.depth = x.depth - 1 WHERE x.depth > 0 GROUP BY x.id, x.depth"""


@query("bfs_in_depth2", _bfs_sql("target", "source", "nation/3", 2))
def bfs_in_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(V.edges(spark, sf_dir), V.nodes(spark, sf_dir).where("id = 'nation/3'"), "in", 2)


@query("bfs_out_all", _bfs_sql("source", "target", "order/1", 12))
def bfs_out_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(V.edges(spark, sf_dir), V.nodes(spark, sf_dir).where("id = 'order/1'"), "out")


def _ppr_sql(alpha: float = 0.25, rounds: int = 25) -> str:
    """The rounds written out one behind the other, each computed once."""
    steps = "".join(
        f""", r{k} AS MATERIALIZED (SELECT id, sum(r) AS r FROM (
  SELECT v AS id, r * share * {1 - alpha} AS r FROM r{k - 1} JOIN links ON id = u
  UNION ALL SELECT id, p * ({alpha} + {1 - alpha} * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT u FROM degree))) FROM restart) GROUP BY id)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH {V.NODES}, {V.EDGES},
kept AS (SELECT source, target FROM edges WHERE relation IN {_WALK} AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
pairs AS (SELECT u, v, count(*) AS m FROM (SELECT source AS u, target AS v FROM kept UNION ALL SELECT target, source FROM kept) GROUP BY u, v),
degree AS MATERIALIZED (SELECT u, sum(m) AS d FROM pairs GROUP BY u),
links AS MATERIALIZED (SELECT u, v, m::DOUBLE / d AS share FROM pairs JOIN degree USING (u)),
restart AS (SELECT id, 0.5::DOUBLE AS p FROM nodes WHERE id IN ('nation/3', 'part/7')), r0 AS (SELECT id, p AS r FROM restart){steps}
SELECT id, round(r / (SELECT max(r) FROM r{rounds}), 9) AS score FROM r{rounds} WHERE r > 0"""


@query("ppr_rank", _ppr_sql())
def ppr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    seeds = n.where("id IN ('nation/3', 'part/7')").withColumn("weight", F.lit(1.0))
    return graph.personalised_pagerank(V.edges(spark, sf_dir), n, seeds).select("id", F.round("score", 9).alias("score"))


@query("dir_clusters_split60", f"""WITH {V.PATHS}, one AS (SELECT split_part(path, '/', 1) AS k, count(*) AS n FROM paths GROUP BY 1),
big AS (SELECT k FROM one WHERE n > 0.6 * (SELECT count(*) FROM paths))
SELECT dir, count(*) AS files FROM (SELECT CASE WHEN split_part(path, '/', 1) IN (SELECT k FROM big)
  THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE split_part(path, '/', 1) END AS dir FROM paths) GROUP BY dir ORDER BY files DESC, dir LIMIT 16""")
def dir_clusters_split60(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paths(spark, sf_dir).withColumn("one", S.dir_key(F.col("path"), 1))
    size = p.groupBy("one").agg(F.count("*").alias("n"))
    big = size.crossJoin(size.agg(F.sum("n").alias("all"))).where("n > 0.6 * all").select(F.col("one").alias("big"))
    keyed = p.join(big, p["one"] == big["big"], "left").select(F.when(F.col("big").isNotNull(), S.dir_key(F.col("path"), 2)).otherwise(F.col("one")).alias("dir"))
    return keyed.groupBy("dir").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dir").limit(16)


@query("map_totals", f"WITH {V.NODES}, {V.EDGES} SELECT (SELECT count(*) FROM nodes) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT kind) FROM nodes) AS kinds, (SELECT count(DISTINCT split_part(path, '/', 1)) FROM nodes) AS dirs")
def map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).agg(F.count("*").alias("symbols"), F.count_distinct("kind").alias("kinds"), F.count_distinct(S.dir_key(F.col("path"), 1)).alias("dirs"))
    return n.crossJoin(V.edges(spark, sf_dir).agg(F.count("*").alias("edges"))).select("symbols", "edges", "kinds", "dirs")


@query("kind_relation_counts", f"WITH {V.NODES}, {V.EDGES} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation")
def kind_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = V.nodes(spark, sf_dir).groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return kinds.unionByName(V.edges(spark, sf_dir).groupBy(F.lit("relation").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


@query("relation_family_counts", f"""WITH {V.EDGES} SELECT CASE WHEN relation = 'contains' THEN 'structure' WHEN relation IN ('calls', 'imports') THEN 'dependency'
  WHEN relation IN ('implements', 'extends') THEN 'contract' ELSE 'association' END AS family, count(*) AS n FROM edges GROUP BY 1""")
def relation_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edges(spark, sf_dir).groupBy(S.relation_family(F.col("relation")).alias("family")).agg(F.count("*").alias("n"))


@query("orphan_symbols", f"WITH {V.NODES}, {V.EDGES} SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)")
def orphan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return V.nodes(spark, sf_dir).select("id").join(ends, "id", "left_anti")


@query("graph_quality", f"""WITH {V.NODES}, {V.EDGES} SELECT relation, count(*) AS n, count(*) FILTER (t.id IS NOT NULL) AS resolved,
  count(*) FILTER (source = target) AS loops, round(100.0 * count(*) FILTER (t.id IS NOT NULL) / count(*), 6) AS percent
  FROM edges LEFT JOIN nodes t ON t.id = target GROUP BY relation""")
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.nodes(spark, sf_dir).select("id")
    e = V.edges(spark, sf_dir)
    g = e.join(ids, e["target"] == ids["id"], "left").groupBy("relation").agg(F.count("*").alias("n"), F.count("id").alias("resolved"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    return g.withColumn("percent", F.round(100 * F.col("resolved") / F.col("n"), 6))


_BAD_NODES = """bn AS (SELECT id, CASE WHEN ord % 97 = 0 THEN ' ' ELSE name END AS name, CASE WHEN ord % 89 = 0 THEN 'gizmo' ELSE kind END AS kind,
  CASE WHEN ord % 83 = 0 THEN 9 ELSE 1 END AS start_line, CASE WHEN ord % 79 = 0 THEN NULL ELSE 5 END AS end_line
  FROM (SELECT *, TRY_CAST(split_part(id, '/', 2) AS INTEGER) AS ord FROM nodes) UNION ALL SELECT 'nation/3', 'again', 'class', 1, 2),
be AS (SELECT source, target, relation, 'extracted' AS confidence FROM edges
  UNION ALL SELECT 'gone/1', 'nation/3', 'calls', 'extracted' UNION ALL SELECT 'nation/3', 'gone/2', 'calls', 'guessed'
  UNION ALL SELECT 'nation/3', 'react', 'imports', 'extracted' UNION ALL SELECT 'nation/3', 'nation/4', 'likes', 'inferred')"""


@query("invariant_violations", f"""WITH {V.NODES}, {V.EDGES}, {_BAD_NODES}
SELECT 'duplicate id' AS problem, id FROM bn GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'empty name', id FROM bn WHERE trim(name) = '' UNION ALL SELECT 'bad kind', id FROM bn WHERE kind = 'gizmo'
UNION ALL SELECT 'bad span', id FROM bn WHERE end_line IS NULL UNION ALL SELECT 'inverted span', id FROM bn WHERE start_line > end_line
UNION ALL SELECT 'bad relation', source FROM be WHERE relation = 'likes' UNION ALL SELECT 'bad confidence', source FROM be WHERE confidence = 'guessed'
UNION ALL SELECT 'dangling source', source FROM be WHERE source NOT IN (SELECT id FROM bn)
UNION ALL SELECT 'dangling target', target FROM be WHERE target NOT IN (SELECT id FROM bn) AND relation NOT IN ('imports', 'extends', 'implements')""")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).withColumn("ord", F.expr("try_cast(split_part(id, '/', 2) as int)"))
    n = n.selectExpr("id", "if(ord % 97 = 0, ' ', name) name", "if(ord % 89 = 0, 'gizmo', kind) kind", "if(ord % 83 = 0, 9, 1) start_line", "if(ord % 79 = 0, null, 5) end_line")
    n = n.unionByName(spark.sql("SELECT 'nation/3' id, 'again' name, 'class' kind, 1 start_line, 2 end_line"))
    more = spark.sql("SELECT * FROM VALUES ('gone/1', 'nation/3', 'calls', 'extracted'), ('nation/3', 'gone/2', 'calls', 'guessed'), ('nation/3', 'react', 'imports', 'extracted'), ('nation/3', 'nation/4', 'likes', 'inferred') AS t(source, target, relation, confidence)")
    return graph.invariant_violations(n, V.edges(spark, sf_dir).unionByName(more))


@query("resolve_symbol", f"WITH {V.NODES} SELECT id, name, kind FROM nodes WHERE lower(name) = 'germany' OR lower(name) = lower((SELECT n_name FROM nation WHERE n_nationkey = 7))")
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    name = V.table(spark, sf_dir, "nation").where("n_nationkey = 7").select("n_name").first()[0]  # one row of a dimension
    return graph.resolve_symbol(n, name).select("id", "name", "kind").unionByName(graph.resolve_symbol(n, "germany").select("id", "name", "kind")).distinct()


_CHANGED = "changed AS (SELECT id FROM nodes WHERE id LIKE 'supplier/%' AND TRY_CAST(split_part(id, '/', 2) AS INTEGER) % 40 = 0)"


@query("blast_radius", f"""WITH RECURSIVE {V.NODES}, {V.EDGES}, {_CHANGED}, walk AS (SELECT target AS near, source AS far FROM edges WHERE relation IN {_WALK}),
b(origin, id, d) AS (SELECT id, id, 0 FROM changed UNION SELECT origin, far, d + 1 FROM b JOIN walk ON near = id WHERE d < 2),
best AS (SELECT origin, id, min(d) AS d FROM b GROUP BY origin, id)
SELECT id, min(d) AS depth, count(*) AS origins, min(origin) AS first_origin FROM best WHERE d > 0 AND id NOT IN (SELECT id FROM changed) GROUP BY id""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    changed = n.where("id LIKE 'supplier/%' AND try_cast(split_part(id, '/', 2) as int) % 40 = 0").select("id")
    return graph.blast_radius(V.edges(spark, sf_dir), changed)


@query("module_group_origins", f"""WITH {V.NODES}, {V.EDGES} SELECT split_part(s.path, '/', 1) || '/' || split_part(s.path, '/', 2) AS module, count(DISTINCT s.id) AS symbols, count(DISTINCT target) AS origins
FROM edges e JOIN nodes s ON s.id = e.source WHERE relation = 'extends' GROUP BY 1 ORDER BY symbols DESC, module""")
def module_group_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).select(F.col("id").alias("source"), S.dir_key(F.col("path"), 2).alias("module"))
    e = V.edges(spark, sf_dir).where("relation = 'extends'")
    return e.join(n, "source").groupBy("module").agg(F.count_distinct("source").alias("symbols"), F.count_distinct("target").alias("origins")).orderBy(F.desc("symbols"), "module")


@query("top5_plus_rest", f"""WITH {V.NODES}, c AS (SELECT split_part(path, '/', 2) AS label, count(*) AS n FROM nodes WHERE kind = 'function' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM c)
SELECT CASE WHEN rn <= 5 THEN label ELSE 'rest' END AS label, sum(n)::BIGINT AS n, count(*) AS members FROM r GROUP BY 1""")
def top5_plus_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.nodes(spark, sf_dir).where("kind = 'function'").groupBy(F.element_at(F.split("path", "/"), 2).alias("label")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "label").limit(5).select("label", F.lit(True).alias("top"))
    named = c.join(F.broadcast(top), "label", "left").select(F.when(F.col("top"), F.col("label")).otherwise("rest").alias("label"), "n")
    return named.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("members"))


@query("test_signal", f"""WITH {V.NODES}, {V.EDGES}, a AS (SELECT split_part(path, '/', 2) AS area, id FROM nodes WHERE kind = 'function'),
t AS (SELECT area, count(DISTINCT a.id) AS symbols, count(DISTINCT source) FILTER (TRY_CAST(split_part(source, '/', 2) AS INTEGER) % 3 = 0) AS tests,
  count(DISTINCT source) FILTER (TRY_CAST(split_part(source, '/', 2) AS INTEGER) % 600 = 0) AS changed FROM a LEFT JOIN edges ON target = a.id GROUP BY area)
SELECT area, symbols, CASE WHEN symbols = 0 THEN 'na' WHEN changed > 0 THEN 'changed' WHEN tests > 0 THEN 'stale' ELSE 'none' END AS tests FROM t""")
def test_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.nodes(spark, sf_dir).where("kind = 'function'").select(F.element_at(F.split("path", "/"), 2).alias("area"), "id")
    e = V.edges(spark, sf_dir).selectExpr("target", "source", "try_cast(split_part(source, '/', 2) as int) k")
    t = a.join(e, a["id"] == e["target"], "left").groupBy("area").agg(F.count_distinct("id").alias("symbols"), F.count_distinct(F.when(F.expr("k % 3 = 0"), F.col("source"))).alias("t"), F.count_distinct(F.when(F.expr("k % 600 = 0"), F.col("source"))).alias("c"))
    return t.select("area", "symbols", F.when(F.col("symbols") == 0, "na").when(F.col("c") > 0, "changed").when(F.col("t") > 0, "stale").otherwise("none").alias("tests"))


@query("outside_incoming", f"""WITH {V.NODES}, {V.EDGES}, own AS (SELECT id FROM nodes WHERE path LIKE 'region/1/%')
SELECT source, relation FROM edges WHERE target IN (SELECT id FROM own) AND source NOT IN (SELECT id FROM own) ORDER BY source LIMIT 8""")
def outside_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.nodes(spark, sf_dir).where(S.under_prefix(F.col("path"), "region/1")).select("id")
    hit = graph.outside_incoming(V.edges(spark, sf_dir), own)
    return hit.select("source", "relation").orderBy("source").limit(8)
