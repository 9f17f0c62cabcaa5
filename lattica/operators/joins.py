"""Join shapes that Spark has no operator for, as compositions of equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.runtime import stored


#: Ids up to which a set of them is sent to all executors instead of shuffling what is looked up in it.
MOST_SENT = 500_000


def few(ids: DataFrame) -> DataFrame:
    """``ids`` stored once, and marked to be broadcast if they are few enough."""
    kept = stored(ids.distinct())
    return F.broadcast(kept) if kept.count() <= MOST_SENT else kept


def prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself, the root (empty) first."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def longest_prefix_join(rows: DataFrame, path: str, scopes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``rows`` with the longest of ``scopes``' prefixes that holds ``path``, or '' where none does.

    A path has as many prefixes as segments, so this is an equi-join on exploded prefixes rather than a
    comparison of every path with every scope. Equal paths are looked up once.
    """
    paths = rows.select(path).distinct()
    hit = (
        paths.select(path, F.explode(prefixes(F.col(path))).alias("_p"))
        .join(scopes.select(F.col(prefix).alias("_s")).distinct(), F.col("_p") == F.col("_s"))
        .groupBy(path)
        .agg(F.max_by("_s", F.length("_s")).alias("scope"))
    )
    found = hit.select(F.col(path).alias("_path"), "scope")
    return rows.join(found, rows[path] == found["_path"], "left").drop("_path").withColumn("scope", F.coalesce("scope", F.lit("")))


def innermost_span_join(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(path, line, ...)`` with the innermost of ``spans(path, id, start_line, end_line, ord)``.

    The greatest start wins, then the greatest ``ord``; points in no span keep a null id.
    """
    s = spans.select(F.col("path").alias("_path"), F.col("id").alias("symbol"), "start_line", "end_line", F.col("ord").alias("_ord"))
    keyed = points.select("path", "line").distinct()
    held = (
        keyed.join(s, (keyed["path"] == s["_path"]) & F.col("line").between(F.col("start_line"), F.col("end_line")))
        .groupBy("path", "line")
        .agg(F.max_by("symbol", F.struct("start_line", "_ord")).alias("symbol"))
    )
    return points.join(held, ["path", "line"], "left")


def overlap_innermost(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """``(path, id)`` of spans that overlap a range and contain no other such span; equal spans void each other."""
    r = ranges.select(F.col("path").alias("_path"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    hit = spans.join(r, (spans["path"] == r["_path"]) & (F.col("start_line") <= F.col("_to")) & (F.col("end_line") >= F.col("_from")), "left_semi")
    inner = hit.select(F.col("path").alias("_p"), F.col("id").alias("_i"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    holds = (F.col("path") == F.col("_p")) & (F.col("id") != F.col("_i")) & (F.col("start_line") <= F.col("_s")) & (F.col("end_line") >= F.col("_e"))
    return hit.join(inner, holds, "left_anti").select("path", "id")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_candidate(wanted: DataFrame, key: list[str], candidates: str, known: DataFrame, id: str = "id") -> DataFrame:
    """``key`` columns with the first entry of the array ``candidates`` that is in ``known``."""
    k = known.select(F.col(id).alias("_id")).distinct()
    return wanted.select(*key, F.posexplode(candidates).alias("_pos", "_c")).join(k, F.col("_c") == F.col("_id")).groupBy(*key).agg(F.min_by("_c", "_pos").alias("target"))


def unique_match(wanted: DataFrame, key: list[str], on: str, known: DataFrame, name: str, id: str = "id") -> DataFrame:
    """``key`` with the only id of ``known`` whose ``name`` equals ``on``; none where several do."""
    one = known.groupBy(F.col(name).alias("_name")).agg(F.count_distinct(id).alias("_n"), F.min(id).alias("target")).where("_n = 1")
    return wanted.join(one, F.col(on) == F.col("_name")).select(*key, "target")


def full_outer_diff(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, drift)`` with drift one of added, removed, changed, same."""
    a = recorded.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = current.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    drift = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, drift.alias("drift"))
