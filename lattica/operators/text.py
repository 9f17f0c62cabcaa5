"""Token bags, statistics and lexical scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import is_test_for_rank, tokens
from lattica.runtime import stored

K1, B = 1.2, 0.75
TEST_PENALTY, GRAPH_WEIGHT, RESCUE_FLOOR = 0.35, 0.5, 0.15
_TEST_WORDS = ("mocks?", "fixtures?", "asserts?", "assertions?", "coverage", "specs?", "tests?")


def token_bags(docs: DataFrame, fields: Sequence[str] = ("name", "path", "body")) -> DataFrame:
    """Long form ``(id, field, token, tf)`` of the given text columns."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])
    return docs.select("id", F.explode(each).alias("x")).select("id", "x.field", F.explode("x.t").alias("token")).groupBy("id", "field", "token").agg(F.count("*").cast("int").alias("tf"))


def document_frequency(bags: DataFrame) -> DataFrame:
    return bags.select("id", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + n / (1 + df))


def corpus_stats(docs: DataFrame, bags: DataFrame) -> DataFrame:
    """One row: ``n`` documents and ``avgdl``, the mean body length with empty bodies counted."""
    total = bags.where("field = 'body'").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return docs.agg(F.count("*").alias("n")).crossJoin(total).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """``(token)``, each once."""
    return spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token"))


def _matched(docs: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(id, dl, name, path, body)``: body length and, of each field, the tokens that are ``wanted``.

    Every text is tokenized once, in one narrow pass that is stored; no token is ever shuffled.
    """

    def of(field: str) -> Column:
        # One element, so that the tokens are bound once and not made anew for each use.
        one = F.transform(F.array(tokens(F.col(field))), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(*wanted)).alias("hits")))
        return one[0].alias(field)

    fields = ("name", "path", "body")
    own = docs.select("id", *[F.col(c).alias(f"_{c}") for c in keep], *map(of, fields))
    hits = [F.coalesce(f"{f}.hits", F.array().cast("array<string>")).alias(f) for f in fields]
    return stored(own.select("id", *[f"_{c}" for c in keep], F.greatest(F.coalesce("body.n", F.lit(0)), F.lit(0)).alias("dl"), *hits))


def _frequencies(matched: DataFrame, terms: Sequence[str]):
    """One row: ``n`` documents, ``total`` body tokens, and for each term how many documents have it."""
    has = [F.count_if(F.array_contains("name", t) | F.array_contains("path", t) | F.array_contains("body", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    return matched.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *has).first()


def _terms(spark: SparkSession, query: str) -> list[str]:
    return [r.token for r in query_terms(spark, query).collect()]


def field_scores(docs: DataFrame, query: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, name_score, path_score, body_score)`` and the columns to ``keep`` of documents with any query term.

    One narrow pass makes body lengths and matching tokens; statistics are one row from it, and scores
    are expressions over it.
    """
    terms = _terms(docs.sparkSession, query)
    if not terms:
        zero = F.lit(0.0)
        return docs.limit(0).select("id", *keep, zero.alias("name_score"), zero.alias("path_score"), zero.alias("body_score"))
    matched = _matched(docs, terms, keep)
    stats = _frequencies(matched, terms)
    average = stats.total / max(stats.n, 1) or 1.0
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(average))

    def summed(field: str, of) -> Column:
        out = F.lit(0.0)
        for i, t in enumerate(terms):
            tf = F.size(field) - F.size(F.array_remove(field, t))
            out = out + F.when(tf > 0, of(F.lit(math.log(1 + stats.n / (1 + stats[f"df{i}"]))), tf)).otherwise(0.0)
        return out.alias(f"{field}_score")

    plain = lambda w, tf: tf * w
    some = matched.where((F.size("name") > 0) | (F.size("path") > 0) | (F.size("body") > 0))
    bm25 = lambda w, tf: w * tf * (K1 + 1) / (tf + norm)
    return some.select("id", *[F.col(f"_{c}").alias(c) for c in keep], summed("name", plain), summed("path", plain), summed("body", bm25))


def asks_for_tests(query: str) -> bool:
    import re

    return bool(re.search(rf"\b(?:{'|'.join(_TEST_WORDS)})\b", query, re.I))


def test_factor(path: Column, query: str) -> Column:
    return F.lit(1.0) if asks_for_tests(query) else F.when(is_test_for_rank(path), TEST_PENALTY).otherwise(1.0)


def lexical_rank(docs: DataFrame, query: str) -> DataFrame:
    """``(id, path, score)``: 3 name + 2 path + BM25 body, tests penalised unless asked for."""
    s = field_scores(docs, query, keep=("path",))
    score = (3 * F.col("name_score") + 2 * F.col("path_score") + F.col("body_score")) * test_factor(F.col("path"), query)
    return s.select("id", "path", score.alias("score"))


def coverage(docs: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """``(id, share)``: idf-weighted share of the query that a document matches, plurals folded."""
    terms = _terms(docs.sparkSession, query)
    if not terms:
        return docs.limit(0).select("id", F.lit(0.0).alias("share"))
    forms = [[t, t + "s", *([t[:-1]] if t.endswith("s") else [])] for t in terms]
    matched = _matched(docs, sorted({f for own in forms for f in own}))
    stats = _frequencies(matched, terms)
    weights = [math.log(1 + stats.n / (1 + df)) if (df := stats[f"df{i}"]) else math.log(1 + stats.n) for i in range(len(terms))]
    share = F.lit(0.0)
    for own, w in zip(forms, weights):
        has = F.lit(False)
        for f in fields:
            has = has | F.arrays_overlap(f, F.array(*map(F.lit, own)))
        share = share + F.when(has, w).otherwise(0.0)
    return matched.select("id", (share / (sum(weights) or 1.0)).alias("share")).where("share > 0")


def blend(lexical: DataFrame, walk: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Lexical and walk scores as one: candidates matched the query, or the walk lifts them over the rescue floor."""
    top = lexical.agg(F.max("score").alias("top"))
    both = lexical.select("id", F.col("score").alias("lex")).join(walk.select("id", F.col("score").alias("pr")), "id", "full_outer").crossJoin(top)
    kept = both.where((F.coalesce("lex", F.lit(0.0)) > 0) | (F.coalesce("pr", F.lit(0.0)) >= RESCUE_FLOOR))
    score = F.coalesce(F.col("lex") / F.nullif("top", F.lit(0.0)), F.lit(0.0)) + GRAPH_WEIGHT * F.coalesce("pr", F.lit(0.0))
    return kept.join(docs.select("id", "path"), "id").select("id", "path", (score * test_factor(F.col("path"), query)).alias("score"))
