"""Fusion of ranked lists across scopes and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, PARTICIPATION, STRONG_FLOOR, HIGH_FLOOR = 60, 0.25, 0.1, 0.5


def gated(docs: DataFrame) -> DataFrame:
    """Positive ``(id, scope, score)`` with the scopes' number and whether each one's best score takes part."""
    best = docs.where("score > 0").groupBy("scope").agg(F.max("score").alias("_best"))
    whole = best.agg(F.max("_best").alias("_top"), F.count("*").alias("_scopes"))
    marks = best.crossJoin(whole).select("scope", "_scopes", (F.col("_best") >= PARTICIPATION * F.col("_top")).alias("_in"))
    return docs.where("score > 0").join(marks, "scope")


def weak_scopes(docs: DataFrame) -> DataFrame:
    """``(scope, best_id)`` of scopes below the participation gate."""
    return gated(docs).where("NOT _in").groupBy("scope").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("best_id"))


def reciprocal_rank_fusion(docs: DataFrame, k: int = RRF_K) -> DataFrame:
    """``(id, scope, score)``: sum of 1/(k + rank) over participating scopes, the best scaled to 1.

    An id belongs to the scope where it ranks best, then to the one with the better top score. A
    single scope passes through unscaled.
    """
    own = gated(docs).where("_in").withColumn("_rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id")))
    own = own.withColumn("_head", F.max("score").over(Window.partitionBy("scope")))
    fused = own.groupBy("id").agg(
        F.min_by("scope", F.struct("_rank", -F.col("_head"), "scope")).alias("scope"), F.sum(1 / (k + F.col("_rank"))).alias("_sum"), F.max("score").alias("_raw"), F.max("_scopes").alias("_scopes")
    )
    top = fused.agg(F.max("_sum").alias("_top"))
    return fused.crossJoin(top).select("id", "scope", F.when(F.col("_scopes") == 1, F.col("_raw")).otherwise(F.col("_sum") / F.col("_top")).alias("score"))


def combine_comparable(docs: DataFrame) -> DataFrame:
    """``(id, scope, score)`` of scopes scored on one scale: gated, each id's best, the greatest scaled to 1."""
    own = gated(docs).where("_in").groupBy("id").agg(F.max_by("scope", F.struct("score", "scope")).alias("scope"), F.max("score").alias("_raw"), F.max("_scopes").alias("_scopes"))
    top = own.agg(F.max("_raw").alias("_top"))
    return own.crossJoin(top).select("id", "scope", F.when(F.col("_scopes") == 1, F.col("_raw")).otherwise(F.col("_raw") / F.col("_top")).alias("score"))


def federation_gate(stats: DataFrame) -> DataFrame:
    """Repositories ``(repo, strong, coverage)`` worth federating."""
    return stats.where((F.col("strong") >= STRONG_FLOOR) | (F.col("coverage") >= HIGH_FLOOR))
