"""Snapshots, caches, sessions and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import joins, state
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


_X = """rec AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
cur AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = V.table(spark, sf_dir, "documents")
    changed = F.concat("text", F.when(F.expr("doc_id % 13 = 0"), "x").otherwise(""))
    return d.where("doc_id % 7 <> 0").select("doc_id", S.content_hash(F.col("text")).alias("hash")), d.where("doc_id % 11 <> 0").select("doc_id", S.content_hash(changed).alias("hash"))


@query("drift_full_outer", f"WITH {_X} SELECT doc_id, CASE WHEN r.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' WHEN r.hash = c.hash THEN 'same' ELSE 'changed' END AS drift FROM rec r FULL JOIN cur c USING (doc_id)")
def drift_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.full_outer_diff(*_snapshots(spark, sf_dir), "doc_id", "hash")


@query("coverage_gap_anti", f"WITH {_X} SELECT doc_id FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM rec)")
def coverage_gap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _snapshots(spark, sf_dir)
    return b.select("doc_id").join(a, "doc_id", "left_anti")


@query("freshness_count", f"WITH {_X} SELECT count(*) AS missing FROM rec WHERE doc_id NOT IN (SELECT doc_id FROM cur)")
def freshness_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _snapshots(spark, sf_dir)
    return a.join(b, "doc_id", "left_anti").agg(F.count("*").alias("missing"))


@query("carry_over_states", f"""WITH {_X} SELECT c.doc_id, CASE WHEN r.doc_id % 3 = 0 AND r.hash = c.hash THEN 'ready' WHEN r.doc_id % 3 <> 2 AND r.doc_id IS NOT NULL THEN 'stale' ELSE 'pending' END AS state
FROM cur c LEFT JOIN rec r ON r.doc_id = c.doc_id""")
def carry_over_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _snapshots(spark, sf_dir)
    prior = a.selectExpr("doc_id id", "hash body_hash", "CASE WHEN doc_id % 3 = 0 THEN 'ready' ELSE 'pending' END summary_state", "CASE WHEN doc_id % 3 <> 2 THEN 'text' END summary")
    return state.carry_over(b.selectExpr("doc_id id", "hash body_hash"), prior).select(F.col("id").alias("doc_id"), F.col("summary_state").alias("state"))


@query("incremental_equals_cold", f"WITH {_X} SELECT doc_id, hash FROM cur")
def incremental_equals_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unchanged documents replayed from the memo, the others computed anew."""
    a, b = _snapshots(spark, sf_dir)
    return state.replay(b, a, ["doc_id", "hash"], lambda misses: misses)


@query("source_digest", "SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT source, lang || '/' || doc_id || ':' || sha256(text) AS line FROM documents) GROUP BY source")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.set_digest(V.table(spark, sf_dir, "documents").select("source", F.concat_ws("/", "lang", "doc_id").alias("path"), S.content_hash(F.col("text")).alias("hash")), "source")


@query("novelty_anti", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def novelty_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_anti").select("event_id")


_GAP = "SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


@query("session_close_2h", f"""WITH g AS ({_GAP.format(gap='2 hour')}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS opened, max(ts) AS last_seen, count(*) AS events, sum((event_type = 'error')::INT)::BIGINT AS errors FROM s GROUP BY user_id, n""")
def session_close_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event time; a session ends two hours after its last event."""
    return state.sessions(V.table(spark, sf_dir, "events"), "2 hours").select("user_id", "opened", "last_seen", "events", "errors")


@query("debounce_quiet", f"""WITH g AS ({_GAP.format(gap='30 minute')}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, max(ts) AS fired, count(*) AS merged FROM s GROUP BY user_id, n""")
def debounce_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(V.table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("last_seen").alias("fired"), F.col("events").alias("merged"))


@query("failure_runs", """WITH g AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
SELECT user_id, min(ts) AS since, count(*) AS failures FROM g WHERE bad GROUP BY user_id, grp HAVING count(*) >= 2""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.runs(V.table(spark, sf_dir, "events"), "event_type = 'error'", 2)


@query("queue_keep_last40", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 40")
def queue_keep_last40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.keep_last(V.table(spark, sf_dir, "events"), 40).select("user_id", "event_id")


@query("queue_keep_last500", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def queue_keep_last500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


_BUCKETS = """CASE WHEN n <= 0 THEN '0' WHEN n < 5 THEN '1-4' WHEN n < 20 THEN '5-19' WHEN n < 50 THEN '20-49' WHEN n < 200 THEN '50-199' ELSE '200+' END"""


@query("bucket_counts", f"SELECT {_BUCKETS} AS bucket, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.groupBy(S.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("users"))


@query("duration_buckets", "SELECT CASE WHEN s < 1 THEN '<1s' WHEN s < 5 THEN '1-5s' WHEN s < 30 THEN '5-30s' WHEN s < 120 THEN '30s-2m' WHEN s < 600 THEN '2-10m' ELSE '10m+' END AS bucket, count(*) AS n FROM (SELECT n_chars / 10.0 AS s FROM documents) GROUP BY 1")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").groupBy(S.duration_bucket(F.col("n_chars") * 100).alias("bucket")).agg(F.count("*").alias("n"))


@query("event_allow_list", """SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type IN ('purchase', 'signup')
UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type NOT IN ('purchase', 'signup')""")
def event_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.allowed_props(V.table(spark, sf_dir, "events"), {"purchase": ["k"], "signup": ["k"]}).select("event_id", "event_type", F.expr("cast(props['k'] as bigint)").alias("k"))


@query("unanimous_concept", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS concept FROM documents WHERE doc_id % 40 = 0 GROUP BY source")
def unanimous_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.table(spark, sf_dir, "documents").where("doc_id % 40 = 0").groupBy("source")
    return g.agg(F.when(F.count_distinct("lang") == 1, F.min("lang")).alias("concept"))


@query("smallest_claim", "SELECT lang, arg_min(source, (n, source)) AS concept FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def smallest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.min_by("source", F.struct("n", "source")).alias("concept"))


@query("latest_two_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 2")
def latest_two_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return V.table(spark, sf_dir, "documents").withColumn("n", n).where("n <= 2").select("source", "doc_id")
