"""Incremental upkeep: replay, carry-over, digests, sessions, bounded queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(current: DataFrame, memo: DataFrame, keys: list[str], extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Memo rows of unchanged files, and ``extract`` of the others; equal to extracting everything."""
    misses = current.join(memo.select(*keys), keys, "left_anti")
    return memo.join(current.select(*keys), keys, "left_semi").unionByName(extract(misses))


def carry_over(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Summary state of each current node: ready while unchanged, stale once there was a summary, else pending."""
    p = prior.select("id", F.col("body_hash").alias("_hash"), F.col("summary_state").alias("_state"), F.col("summary").alias("_text"))
    same = (F.col("_state") == "ready") & (F.col("_hash") == F.col("body_hash"))
    out = F.when(same, "ready").when(F.col("_text").isNotNull(), "stale").otherwise("pending")
    return current.join(p, "id", "left").select(*[current[c] for c in current.columns], out.alias("summary_state"), F.col("_text").alias("summary"))


def set_digest(rows: DataFrame, group: str) -> DataFrame:
    """``(group, digest)``: SHA-256 of the sorted ``path:hash`` lines."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash")))
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """One row a user and session; works on a stream with a watermark as on a table."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = g.agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("user_id", "opened", "last_seen", "events", "errors")


def runs(events: DataFrame, bad: str, least: int) -> DataFrame:
    """``(user_id, since, failures)`` of unbroken runs of ``bad`` events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("_bad", F.expr(bad)).withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w))
    return marked.where("_bad").groupBy("user_id", "_run").agg(F.min("ts").alias("since"), F.count("*").alias("failures")).where(F.col("failures") >= least).drop("_run")


def keep_last(events: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def allowed_props(events: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Events whose JSON ``props`` keep only the keys allowed for their type, as a map."""
    props = F.from_json("props", "map<string,string>")
    out = F.when(F.lit(False), props)
    for kind, keys in allowed.items():
        listed = ", ".join(f"'{k}'" for k in keys)
        out = out.when(F.col("event_type") == kind, F.expr(f"map_filter(from_json(props, 'map<string,string>'), (k, v) -> k IN ({listed}))"))
    return events.withColumn("props", out)
