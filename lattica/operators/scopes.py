"""Discovery of sub-projects in a tree of files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import first_rows

MARKERS = tuple("Cargo.toml Gemfile build.gradle build.gradle.kts composer.json go.mod package.json pom.xml pyproject.toml setup.py".split())
MOST_DEPTH, LEAST_SYMBOLS = 2, 5


def glob_pattern(glob: str) -> str:
    """Java pattern of a workspace glob over directories: ``*`` stays in a segment, ``**`` crosses them."""
    parts = re.split(r"(\*\*|\*|\?)", glob.strip().removeprefix("./").rstrip("/"))
    return "^" + "".join({"**": ".+", "*": "[^/]+", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def _ancestors(path):
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def _nearest(rows: DataFrame) -> DataFrame:
    """``(prefix, up, up_workspace)``: the nearest ancestor among the same rows, the root left out."""
    up = rows.where("prefix <> ''").select(F.col("prefix").alias("up"), F.col("workspace").alias("up_workspace"))
    pairs = rows.select("prefix", F.explode(_ancestors(F.col("prefix"))).alias("up")).join(up, "up")
    return first_rows(pairs, ["prefix"], [F.desc(F.length("up"))])


def discover(files: DataFrame, globs: Sequence[str] | None = None) -> DataFrame:
    """``(prefix, label, markers)`` of the sub-projects of files ``(path)``.

    A directory counts by its marker files up to two levels deep, or at any depth by a workspace glob;
    where globs are given, a package file alone counts only in directories that they name. A glob's
    match replaces a plain parent; any other nested pair keeps the shallower. With no scope left the
    root is the only one.
    """
    parts = F.split("path", "/")
    split = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("file"))
    marks = split.where(F.col("file").isin(*MARKERS)).groupBy(F.col("dir").alias("prefix")).agg(F.array_sort(F.collect_set("file")).alias("markers"))
    dirs = split.select("dir").distinct().select(F.explode(F.concat(_ancestors(F.col("dir")), F.array("dir"))).alias("prefix")).distinct()
    matched = dirs.where(F.lit(False))
    for glob in globs or ():
        matched = matched.union(dirs.where((F.col("prefix") != "") & F.col("prefix").rlike(glob_pattern(glob))))
    named = matched.distinct().withColumn("workspace", F.lit(True))
    every = marks.join(named, "prefix", "full_outer").select("prefix", F.coalesce("markers", F.array().cast("array<string>")).alias("markers"), F.coalesce("workspace", F.lit(False)).alias("workspace"))
    if globs is not None:
        plain = F.when(F.col("workspace"), F.col("markers")).otherwise(F.array_remove("markers", "package.json"))
        every = every.withColumn("markers", plain).where((F.size("markers") > 0) | F.col("workspace"))
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    frozen = every.where((depth <= MOST_DEPTH) | F.col("workspace"))
    replaced = _nearest(frozen).join(frozen.where("workspace").select("prefix"), "prefix", "left_semi").where("NOT up_workspace").select(F.col("up").alias("prefix"))
    left = frozen.join(replaced, "prefix", "left_anti")
    nested = _nearest(left).join(left.select("prefix", "workspace"), "prefix").where("NOT workspace OR up_workspace").select("prefix")
    kept = left.join(nested, "prefix", "left_anti")
    out = kept.select("prefix", F.col("prefix").alias("label"), "markers")
    root = files.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit("").alias("label"), F.array().cast("array<string>").alias("markers"))
    return out.unionByName(root.join(out.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def with_substance(scopes: DataFrame, symbols: DataFrame, least: int = LEAST_SYMBOLS) -> DataFrame:
    """Scopes that hold enough of ``symbols(path)``; the root always stays."""
    from lattica.operators.joins import longest_prefix_join

    size = longest_prefix_join(symbols.select("path"), "path", scopes).groupBy(F.col("scope").alias("prefix")).agg(F.count("*").alias("_n"))
    return scopes.join(size, "prefix", "left").where((F.col("prefix") == "") | (F.coalesce("_n", F.lit(0)) >= least)).drop("_n")
