"""Column functions: text, paths, spans, labels and buckets. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a an and are can do does for get how i in is it of on or set that the this to use used using we what when where which why with".split())

#: Paths of tests, as ranking sees them, and as change reports do; the two differ on purpose.
RANK_TEST_PATH = "(?i)" + "|".join((r"(?:^|/)(?:spec|__tests__|tests?)/", r"[._]test\.[a-z]+$", r"\.spec\.[a-z]+$", r"(?:^|/)conftest\.py$", r"(?:^|/)test_[^/]+\.py$"))
REPORT_TEST_PATH = "(?i)" + "|".join((r"(?:^|/)(?:__tests__|specs?|tests?)/", r"_test\.(?:rb|py|go)$", r"\.(?:spec|test)\.[cm]?[jt]sx?$"))

FAMILIES = {"contains": "structure", "part_of": "structure", "calls": "dependency", "imports": "dependency", "uses": "dependency", "depends_on": "dependency", "implements": "contract", "extends": "contract", "validates": "contract", "configures": "contract", "references": "association"}
RENAMED = dict.fromkeys(("defines", "measures", "supports"), "validates") | {"influences": "configures"}


def tokens(text: Column) -> Column:
    """Lower-case subwords of prose and identifiers, without stop words and single characters."""
    split = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([0-9a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(split, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("node"))


def under_prefix(path: Column, prefix: str) -> Column:
    """Segment-aware: the empty prefix holds everything, ``a`` holds ``a`` and ``a/b`` but not ``ab``."""
    return F.lit(True) if prefix == "" else (path == prefix) | path.startswith(prefix + "/")


def normal_prefix(prefix: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(prefix, r"\\", "/"), r"^(\./)+", ""), "/+$", "")


def dir_key(path: Column, depth: Column | int) -> Column:
    """The first ``depth`` segments; all of them where there are fewer."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def dir_label(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "(root)").otherwise(F.concat(F.regexp_replace(path, "/[^/]*$", ""), F.lit("/")))


def parent_dir(directory: Column) -> Column:
    bare = F.regexp_replace(directory, "/$", "")
    return F.when(F.instr(bare, "/") == 0, "").otherwise(F.concat(F.regexp_replace(bare, "/[^/]*$", ""), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def span(start: Column, end: Column) -> Column:
    return F.concat(F.lit("L"), start, F.lit("-L"), end)


def span_start(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^L(\d+)-L(\d+)$", 1), F.lit("")).cast("int")


def span_end(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^L(\d+)-L(\d+)$", 2), F.lit("")).cast("int")


def search_body(text: Column, most: int = 5000) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def clean_signature(header: Column) -> Column:
    flat = F.trim(F.regexp_replace(header, r"\s+", " "))
    return F.nullif(F.trim(F.regexp_replace(flat, r"\s*(=>|[{:=])$", "")), F.lit(""))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")


def token_estimate(chars: Column) -> Column:
    return F.round(chars / 4).cast("long")


def scope_label(prefix: Column) -> Column:
    return F.when(prefix == "", "(root)").otherwise(prefix)


def renamed_relation(relation: Column) -> Column:
    out = F.when(F.lit(False), relation)
    for old, new in RENAMED.items():
        out = out.when(relation == old, new)
    return out.otherwise(relation)


def relation_family(relation: Column) -> Column:
    out = F.when(F.lit(False), relation)
    for name, family in FAMILIES.items():
        out = out.when(relation == name, family)
    return out.otherwise("association")


def bucket(value: Column, names: list[tuple[float, str]], last: str, zero: str | None = None) -> Column:
    out = F.when(value <= 0, zero) if zero is not None else F.when(F.lit(False), "")
    for below, name in names:
        out = out.when(value < below, name)
    return out.otherwise(last)


def files_bucket(n: Column) -> Column:
    return bucket(n, [(50, "1-49"), (200, "50-199"), (1000, "200-999"), (5000, "1000-4999")], "5000+", "0")


def duration_bucket(ms: Column) -> Column:
    return bucket(ms / 1000, [(1, "<1s"), (5, "1-5s"), (30, "5-30s"), (120, "30s-2m"), (600, "2-10m")], "10m+")


def count_bucket(n: Column) -> Column:
    return bucket(n, [(5, "1-4"), (20, "5-19"), (50, "20-49"), (200, "50-199")], "200+", "0")


def saved_tokens_bucket(n: Column) -> Column:
    return bucket(n, [(1000, "<1k"), (5000, "1-5k"), (20000, "5-20k"), (100000, "20-100k")], "100k+", "0")


def version_key(version: Column) -> Column:
    """Numeric parts, comparable as arrays."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


def prefixed_pointers(child: Column, pointer: Column) -> Column:
    return F.array_join(F.transform(F.split(pointer, ", "), lambda p: F.concat(child, F.lit("/"), p)), ", ")


def languages_value(languages: Column, most: int = 8) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.filter(languages, lambda x: x.rlike("^[a-z][a-z0-9+#-]{0,19}$")))), 1, most)


def is_test_for_rank(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(RANK_TEST_PATH)


def is_test_for_report(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(REPORT_TEST_PATH)
