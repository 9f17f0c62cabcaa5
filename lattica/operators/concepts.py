"""Concepts and their sources, keys of sets of files, and what an edit or a start directory reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators.reports import short_label

SUMMARY_CHARS, EDIT_CAP = 500, 8


def concepts_by_path(concepts: DataFrame) -> DataFrame:
    """``(path, slugs)``: the concepts that cite each source path, in order of slug."""
    cited = concepts.select("slug", F.explode("sources").alias("path")).distinct()
    return cited.groupBy("path").agg(F.array_sort(F.collect_list("slug")).alias("slugs"))


def covers(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(slug, path, name, kind, start_line, end_line)``: the symbols in each concept's sources, files left out."""
    cited = concepts.select("slug", F.explode("sources").alias("path")).distinct()
    return cited.join(nodes.where("kind <> 'file'"), "path").select("slug", "path", "name", "kind", "start_line", "end_line")


def concepts_under(concepts: DataFrame, prefix: str) -> DataFrame:
    """Concepts with any source under the prefix."""
    return concepts.where(F.exists("sources", lambda s: S.under_prefix(s, prefix)))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_liner(summary: Column, signature: Column) -> Column:
    """The first line of the summary, else the signature, else empty."""
    first = bare(F.substring_index(bare(summary), "\n", 1))
    return F.coalesce(F.nullif(first, F.lit("")), bare(signature), F.lit(""))


def generated_summary(body: Column, start: str, end: str, most: int = SUMMARY_CHARS) -> Column:
    """The prose between the markers (all where they are missing), without what follows ``## Related`` and the heading."""
    inside = F.when((F.instr(body, start) > 0) & (F.instr(body, end) > F.instr(body, start)), F.substring_index(F.substring_index(body, end, 1), start, -1)).otherwise(body)
    text = bare(F.regexp_replace(F.substring_index(inside, "## Related", 1), r"(?m)^##[ \t]+Summary[ \t]*$", ""))
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("…"))).otherwise(text)


def flat_name(raw: Column) -> Column:
    """A name from outside on one line, without anything that could open a tag, a label or a table cell."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"[<>\"'`|(){}\[\]#]", ""), r"\s+", " "))


def sanitized(raw: Column) -> Column:
    """``flat_name``, shortened for a label."""
    return F.udf(lambda s: None if s is None else short_label(s), "string", useArrow=True)(flat_name(raw))


def set_keys(rows: DataFrame, group: str, missing: str = "", chars: int = 64) -> DataFrame:
    """``(group, key)``: a digest of each group's ``(path, hash)`` rows in order, the same however the group is called."""
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit(":"), F.coalesce("hash", F.lit(missing)))))
    return rows.groupBy(group).agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, chars).alias("key"))


def test_only(files: DataFrame, module: str) -> DataFrame:
    """``(module, test_only)``: whether all of a module's files are tests."""
    return files.groupBy(module).agg(F.bool_and(S.is_test_for_report(F.col("path"))).alias("test_only"))


def enclosing_definition(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points(path, line)`` with the smallest of ``spans`` around each, the first of equal ones; null outside all."""
    s = spans.select(F.col("path").alias("_path"), "id", "start_line", "end_line", "ord")
    hit = points.join(s, (points["path"] == s["_path"]) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("path", "line").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "ord")).alias("symbol"))
    return points.join(best, ["path", "line"], "left")


def scope_counts(hits: DataFrame) -> DataFrame:
    """``(scope, hits)`` of the displayed hits that have a scope."""
    return hits.where("scope IS NOT NULL").groupBy("scope").agg(F.count("*").alias("hits"))


def nearest_root(starts: DataFrame, roots: DataFrame) -> DataFrame:
    """``(path, root, levels)``: the nearest of ``roots(dir)`` at or above each path; the path itself where there is none."""
    parts = F.split("path", "/")
    up = starts.select("path", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("levels", "dir"))
    best = up.join(roots.select("dir").distinct(), "dir").groupBy("path").agg(F.min_by("dir", "levels").alias("root"), F.min("levels").alias("levels"))
    return starts.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("root", "path").alias("root"), F.coalesce("levels", F.lit(0)).alias("levels"))


def edit_blast(nodes: DataFrame, edges: DataFrame, cap: int = EDIT_CAP) -> DataFrame:
    """``(path, dependents, list)``: who depends on each file from outside it, ``cap`` lines and how many more."""
    at = nodes.select(F.col("id").alias("target"), "path")
    by = nodes.select(F.col("id").alias("source"), F.col("name").alias("_name"), F.col("path").alias("_from"))
    incoming = edges.join(at, "target").join(by, "source", "left").where("_from IS NULL OR _from <> path")
    label = F.coalesce(F.concat("_name", F.lit(" ("), S.base_name(F.col("_from")), F.lit(")")), "source")
    rows = incoming.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("source", "relation", "target", F.concat("relation", F.lit(" <- "), label).alias("line")))).alias("r"))
    shown = F.array_join(F.transform(F.slice("r", 1, cap), lambda x: x["line"]), "\n")
    more = F.when(F.size("r") > cap, F.concat(F.lit("\n+"), F.size("r") - cap, F.lit(" more"))).otherwise("")
    return rows.select("path", F.size("r").cast("long").alias("dependents"), F.concat(shown, more).alias("list"))


def pack_saving(pack_chars: Column, baseline_chars: Column) -> Column:
    """Tokens that a pack saves against reading its files whole; 0 where it saves none."""
    saved = S.token_estimate(baseline_chars) - S.token_estimate(pack_chars)
    return F.when((baseline_chars > 0) & (saved > 0), saved).otherwise(F.lit(0).cast("long"))
