"""Retrieval queries: statistics, lexical and blended ranks, coverage, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import fuse, text
from lattica.plans import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = "thing nation country heath of keit pour reading"
_TERM_ROWS = f"terms AS (SELECT DISTINCT unnest({V.sql_tokens(repr(TERMS))}) AS token)"
_IDF = "w AS (SELECT token, ln(1 + n / (1 + df)) AS w FROM df JOIN terms USING (token), stats)"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


@query("bm25_top10", f"""WITH {V.BAGS}, {_TERM_ROWS}, {_IDF},
len AS (SELECT id, sum(tf) AS dl FROM bags WHERE field = 'body' GROUP BY id)
SELECT id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM bags JOIN w USING (token) JOIN len USING (id), stats WHERE field = 'body' GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.field_scores(V.corpus(spark, sf_dir), TERMS).where("body_score > 0")
    return s.select("id", F.round("body_score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("token_df_idf", f"WITH {V.BAGS} SELECT token, df, round(ln(1 + n / (1 + df)), 9) AS idf FROM df, stats")
def token_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.corpus(spark, sf_dir)
    return text.document_frequency(text.token_bags(docs)).crossJoin(docs.agg(F.count("*").alias("n"))).select("token", "df", F.round(text.idf(F.col("df"), F.col("n")), 9).alias("idf"))


@query("token_bag_totals", f"WITH {V.BAGS} SELECT field, count(*) AS bags, sum(tf)::BIGINT AS tokens, max(tf) AS most FROM bags GROUP BY field")
def token_bag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.token_bags(V.corpus(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("bags"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query("mean_body_length", f"WITH {V.BAGS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def mean_body_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.corpus(spark, sf_dir)
    return text.corpus_stats(docs, text.token_bags(docs)).select("n", F.round("avgdl", 6).alias("avgdl"))


_LEX = f"""WITH {V.BAGS}, {_TERM_ROWS}, {_IDF}, len AS (
  SELECT c.id, coalesce(sum(tf), 0) AS dl FROM corpus c LEFT JOIN (SELECT * FROM bags WHERE field = 'body') b ON c.id = b.id GROUP BY c.id),
lex AS (
  SELECT id, sum(CASE field WHEN 'name' THEN 3 * tf * w WHEN 'path' THEN 2 * tf * w
         ELSE w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) END) AS score
  FROM bags JOIN w USING (token) JOIN len USING (id), stats GROUP BY id)"""


@query("lexical_rank_top20", f"{_LEX} SELECT id, path, round(score, 6) AS score FROM lex JOIN corpus USING (id) ORDER BY score DESC, id LIMIT 20")
def lexical_rank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = text.lexical_rank(V.corpus(spark, sf_dir), TERMS)
    return r.select("id", "path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("field_overlap_rank", f"""{_LEX} SELECT id, round(sum(tf * w), 6) AS overlap FROM bags JOIN w USING (token) WHERE field = 'name' GROUP BY id""")
def field_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.field_scores(V.corpus(spark, sf_dir), TERMS).where("name_score > 0").select("id", F.round("name_score", 6).alias("overlap"))


def _coverage_sql(where: str) -> str:
    return f"""WITH {V.BAGS}, {_TERM_ROWS}, w AS (SELECT t.token AS term, coalesce(ln(1 + n / (1 + df)), ln(1 + n)) AS w FROM terms t LEFT JOIN df ON t.token = df.token, stats),
hit AS (SELECT DISTINCT id, term, w FROM bags JOIN w ON token = term OR token = term || 's' OR (suffix(term, 's') AND token = substr(term, 1, length(term) - 1)) WHERE {where})
SELECT id, round(sum(w) / (SELECT sum(w) FROM w), 6) AS share FROM hit GROUP BY id"""


@query("coverage_share", _coverage_sql("true"))
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.coverage(V.corpus(spark, sf_dir), TERMS, ("name", "path", "body")).select("id", F.round("share", 6).alias("share"))


@query("strong_share", _coverage_sql("field = 'name'"))
def strong_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.coverage(V.corpus(spark, sf_dir), TERMS, ("name",)).select("id", F.round("share", 6).alias("share"))


@query("lexical_blend", f"""{_LEX}, walk AS (SELECT doc_id AS id, 1.0 / (1 + doc_id % 17) AS pr FROM documents WHERE doc_id % 3 = 0)
SELECT id, round(coalesce(score, 0) / (SELECT max(score) FROM lex) + 0.5 * coalesce(pr, 0), 6) AS score
FROM lex FULL JOIN walk USING (id) WHERE coalesce(score, 0) > 0 OR coalesce(pr, 0) >= 0.15""")
def lexical_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.corpus(spark, sf_dir)
    walk = docs.where("id % 3 = 0").selectExpr("id", "1D / (1 + id % 17) score")
    return text.blend(text.lexical_rank(docs, TERMS), walk, docs, TERMS).select("id", F.round("score", 6).alias("score"))


_SCOPED = """docs AS (SELECT doc_id AS id, lang AS scope, CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.5 WHEN 'es' THEN 0.25 ELSE 0.2 END * (1.0 / (1 + doc_id % 101)) AS score FROM documents WHERE doc_id % 5 = 0),
best AS (SELECT scope, max(score) AS b FROM docs GROUP BY scope), gate AS (SELECT scope, b FROM best WHERE b >= 0.25 * (SELECT max(b) FROM best))"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = "CASE lang WHEN 'en' THEN 1D WHEN 'fr' THEN 0.5D WHEN 'es' THEN 0.25D ELSE 0.2D END"
    return V.table(spark, sf_dir, "documents").where("doc_id % 5 = 0").selectExpr("doc_id id", "lang scope", f"{weight} * (1D / (1 + doc_id % 101)) score")


@query("rrf_fuse", f"""WITH {_SCOPED}, r AS (SELECT d.*, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS rk FROM docs d JOIN gate USING (scope))
SELECT id, scope, round((1.0 / (60 + rk)) / (SELECT max(1.0 / (60 + rk)) FROM r), 9) AS score FROM r""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.reciprocal_rank_fusion(_scoped(spark, sf_dir)).select("id", "scope", F.round("score", 9).alias("score"))


@query("comparable_combine", f"WITH {_SCOPED} SELECT id, scope, round(score / (SELECT max(b) FROM gate), 9) AS score FROM docs JOIN gate USING (scope)")
def comparable_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.combine_comparable(_scoped(spark, sf_dir)).select("id", "scope", F.round("score", 9).alias("score"))


@query("weak_scopes", f"WITH {_SCOPED} SELECT scope, arg_min(id, (-score, id)) AS best_id FROM docs WHERE scope NOT IN (SELECT scope FROM gate) GROUP BY scope")
def weak_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.weak_scopes(_scoped(spark, sf_dir))


@query("federation_gate", "SELECT source AS repo, round(avg((lang = 'de')::INT), 6) AS strong, round(avg((n_chars > 2000)::INT), 6) AS coverage FROM documents GROUP BY source HAVING avg((lang = 'de')::INT) >= 0.1 OR avg((n_chars > 2000)::INT) >= 0.5")
def federation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = V.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.avg(F.expr("int(lang = 'de')")).alias("strong"), F.avg(F.expr("int(n_chars > 2000)")).alias("coverage"))
    return fuse.federation_gate(stats).select("repo", F.round("strong", 6).alias("strong"), F.round("coverage", 6).alias("coverage"))


@query("slugify_names", """SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(substr(text, 1, 40))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'node') AS slug FROM documents""")
def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", S.slug(F.substring("text", 1, 40)).alias("slug"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


@query("search_bodies", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 5000) AS body FROM documents")
def search_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", S.search_body(F.col("text")).alias("body"))


@query("savings_estimate", """SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / 4.0)::BIGINT AS tokens,
  round(100.0 * (1 - 2000.0 / sum(n_chars)))::BIGINT AS percent FROM documents GROUP BY source""")
def savings_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    return g.select("source", "files", "chars", S.token_estimate(F.col("chars")).alias("tokens"), F.round(100 * (1 - 2000 / F.col("chars"))).cast("long").alias("percent"))
