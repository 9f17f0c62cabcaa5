"""File tables: scanning source trees, reading text, telling languages, drift against a recorded state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.runtime import ship

MOST_BYTES = 1_000_000
SKIPPED = tuple("__pycache__ build coverage dist node_modules out target vendor venv".split())

#: suffix, grammar, label, tier. The longest suffix that fits decides; depth wins over breadth.
LANGUAGES = (
    (".ts", "typescript", "typescript", "depth"), (".tsx", "tsx", "typescript", "depth"), (".mts", "typescript", "typescript", "depth"),
    (".js", "tsx", "javascript", "depth"), (".jsx", "tsx", "javascript", "depth"), (".mjs", "tsx", "javascript", "depth"), (".cjs", "tsx", "javascript", "depth"),
    (".py", "python", "python", "depth"), (".go", "go", "go", "depth"), (".java", "java", "java", "depth"), (".php", "php", "php", "depth"),
    (".rs", "rust", "rust", "breadth"), (".c", "c", "c", "breadth"), (".h", "c", "c", "breadth"), (".cpp", "cpp", "cpp", "breadth"), (".hpp", "cpp", "cpp", "breadth"),
    (".cs", "c_sharp", "csharp", "breadth"), (".rb", "ruby", "ruby", "breadth"), (".kt", "kotlin", "kotlin", "breadth"), (".swift", "swift", "swift", "breadth"),
    (".scala", "scala", "scala", "breadth"), (".lua", "lua", "lua", "breadth"), (".sh", "bash", "bash", "breadth"), (".vue", "vue", "vue", "container"),
)


def skipped(path: Column, includes: tuple[str, ...] = ()) -> Column:
    """Any segment is a dot name, or a build or vendor name that isn't explicitly included."""
    names = [n for n in SKIPPED if n not in includes]
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin(*names))


def decoded(content: Column) -> Column:
    """UTF-16 little-endian by its mark, big-endian refused, else UTF-8."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(mark == "FEFF", None).otherwise(F.decode(content, "UTF-8"))


def language(path: Column, field: int = 1) -> Column:
    """Grammar (1), label (2) or tier (3) of a path; null where no parser claims it."""
    out = F.when(F.lit(False), "")
    for row in sorted(LANGUAGES, key=lambda r: -len(r[0])):
        out = out.when(F.lower(path).endswith(row[0]), row[field])
    return out


def scan(spark: SparkSession, root: str, includes: tuple[str, ...] = ()) -> DataFrame:
    """``(path, size, mtime_ms, hash, text)`` of the readable files under ``root``; the listing is Spark's own."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    rel = raw.withColumn("rel", F.expr(f"substring(path, {len(base) + 1})")).where(~skipped(F.col("rel"), includes))
    return rel.select(
        F.col("rel").alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime")).cast("double").alias("mtime_ms"),
        F.sha2(F.col("content"), 256).alias("hash"), decoded(F.col("content")).alias("text"),
    )


def source_files(files: DataFrame) -> DataFrame:
    """Files that some parser claims, with their grammar, label and tier."""
    p = F.col("path")
    return files.select("*", language(p).alias("grammar"), language(p, 2).alias("language"), language(p, 3).alias("tier")).where("grammar IS NOT NULL")


def unsupported(files: DataFrame) -> DataFrame:
    """``(extension, files)`` of what no parser claims."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(language(F.col("path")).isNull()).groupBy(ext.alias("extension")).agg(F.count("*").alias("files"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, drift)``: files whose size and time are as recorded are clean without a look at their hash."""
    a = recorded.select("path", F.col("size").alias("_s"), F.col("mtime_ms").alias("_m"), F.col("hash").alias("_h"), F.lit(True).alias("_was"))
    b = current.select("path", "size", "mtime_ms", "hash", F.lit(True).alias("_is"))
    same = (F.col("_s") == F.col("size")) & (F.col("_m") == F.col("mtime_ms")) | (F.col("_h") == F.col("hash"))
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~same, "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("drift")).where("drift IS NOT NULL")


def go_modules(files: DataFrame) -> DataFrame:
    """``(module, dir)`` of each go.mod."""
    found = F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1)
    return files.where("path = 'go.mod' OR path LIKE '%/go.mod'").select(found.alias("module"), F.regexp_replace("path", "/?go\\.mod$", "").alias("dir")).where("module <> ''")


STATUS, HUNK_LINES, FILE_LINES = {"A": "added", "M": "modified", "D": "deleted", "T": "modified"}, 24, 200


def parse_statuses(text: str) -> Iterator[tuple[str, str, str | None]]:
    """``(path, status, old path)`` from NUL-separated name and status output; renames take three fields."""
    parts = iter([p for p in text.split("\0") if p])
    for code in parts:
        if code[0] in "RC":
            old, new = next(parts, None), next(parts, None)
            if new:
                yield new, "renamed" if code[0] == "R" else "added", old
        elif (path := next(parts, None)) is not None:
            yield path, STATUS.get(code[0], "modified"), None


def parse_hunks(patch: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """``(path, first, last, lines)`` of the new side of each hunk; a pure deletion is the line it leaves."""
    import re

    path, hunk, held, used = None, None, [], 0
    for line in [*patch.split("\n"), "@@"]:
        header = re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)
        if header or line.startswith("diff --git") or line == "@@":
            if hunk and path:
                yield path, *hunk, held
            hunk, held = None, []
        if line.startswith("diff --git"):
            path, used = None, 0
        elif line.startswith("+++ "):
            path = None if line[4:] == "/dev/null" else re.sub(r"^b/", "", line[4:].rstrip("\t"))
        elif header:
            first, n = int(header[1]), int(header[2] or 1)
            hunk = (max(first, 1), max(first, 1) if n == 0 else first + n - 1)
        elif hunk and line[:1] in "+-" and len(held) < HUNK_LINES and used < FILE_LINES:
            held.append(line)
            used += 1


def changed_ranges(patches: DataFrame) -> DataFrame:
    """``(path, start, end, lines)`` of the ``patch`` column's hunks, parsed in Arrow batches."""
    ship(patches.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p in batch.column("patch").to_pylist() if p for r in parse_hunks(p)]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))], names=["path", "start", "end", "lines"])

    return patches.select("patch").mapInArrow(parse, "path string, start int, end int, lines array<string>")
