"""Line-level reports: search, residual text, batches, coarsened directories."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import innermost_span_join
from lattica.runtime import ship

_JOINTS = tuple("across and by for from in of over to using via with".split())
_CALLER_WORDS = ("used by", "uses", "called by", "what calls", "who calls", "callers?", "calls? into")
_CALLEE_WORDS = ("depends on", "imports?", "calls what", r"what does \w+ call", "callees?")
HIT_CHARS, MOST_HITS, RESIDUAL_CHARS, BATCH_CHARS = 160, 300, 16_000, 48_000


def grep(lines: DataFrame, spans: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False) -> DataFrame:
    """``(path, line, text, symbol)`` of lines that match, each with its innermost symbol."""
    text = F.lower("text") if literal and ignore_case else F.col("text")
    found = text.contains(pattern.lower() if ignore_case else pattern) if literal else text.rlike(("(?i)" if ignore_case else "") + pattern)
    hits = lines.where(found).select("path", "line", F.substring(F.trim("text"), 1, HIT_CHARS).alias("text"))
    return innermost_span_join(hits, spans)


def residual(lines: DataFrame, spans: DataFrame, most: int = RESIDUAL_CHARS) -> DataFrame:
    """``(path, lines, residual)``: the text of lines in no span, white space collapsed."""
    s = spans.select(F.col("path").alias("_path"), "start_line", "end_line")
    rest = lines.join(s, (lines["path"] == s["_path"]) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")
    g = rest.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    flat = F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), " "), r"\s+", " "))
    return g.select("path", F.size("l").cast("long").alias("lines"), F.substring(flat, 1, most).alias("residual"))


def greedy_batches(sizes: DataFrame, budget: int = BATCH_CHARS) -> DataFrame:
    """``(group, id, batch)``: items of a group in order of id, a new batch where the next would pass ``budget``.

    A running sum that resets is sequential inside a group, so groups are spread and sorted, and each is
    one walk in Arrow batches that holds two numbers.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch_no, used = object(), 0, 0
        for batch in batches:
            out = []
            for g, size in zip(batch.column("group").to_pylist(), batch.column("size").to_pylist()):
                if g != group:
                    group, batch_no, used = g, 0, 0
                size = size or 0
                if used > 0 and used + size > budget:
                    batch_no, used = batch_no + 1, 0
                used += size
                out.append(batch_no)
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("id"), pa.array(out, pa.int64())], names=["group", "id", "batch"])

    ship(sizes.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    rows = sizes.select("group", "id", F.col("size").cast("long").alias("size")).repartition("group").sortWithinPartitions("group", "id")
    return rows.mapInArrow(walk, f"`group` {kinds['group']}, id {kinds['id']}, batch long")


def coarsen(groups: dict[str, list[str]], most: int = 5) -> dict[str, list[str]]:
    """Fold the deepest directories into their parents until few are left; a tiny, sequential table."""

    def parent(d: str) -> str:
        head = d.rstrip("/").rpartition("/")[0]
        return head + "/" if head else ""

    out = {k: list(v) for k, v in groups.items()}
    while len(out) > most:
        foldable = sorted((k for k in out if k), key=lambda d: (parent(d) not in out, -d.count("/"), d))
        if not foldable:
            break
        pick = foldable[0]
        out.setdefault(parent(pick), []).extend(out.pop(pick))
    return out


def short_label(label: str, most: int = 30) -> str:
    """A name that fits a small box: cut at a clause word, else at a word with an ellipsis."""
    import re

    bare = re.sub(r"^concepts?:\s*", "", label, flags=re.I).strip()
    if len(bare) <= most:
        return bare
    joint = re.search(rf":\s|\s(?:{'|'.join(_JOINTS)})\s|\s[(—]|\s-\s", bare, re.I)
    if joint and 8 <= joint.start() <= most:
        return bare[: joint.start()].rstrip()
    cut = bare.rfind(" ", 0, most + 1)
    return bare[: cut if cut > most / 2 else most].rstrip() + "…"


def depth_of(text: str | int | None, default: int) -> int | None:
    """A walk's depth from user input: None is unbounded."""
    if text is None:
        return default
    if isinstance(text, str) and text.strip().lower() in ("all", "full", "max"):
        return None
    value = float(text)
    if not math.isfinite(value) or value < 1:
        raise ValueError(f"depth must be at least 1 or 'all', not {text!r}")
    return math.floor(value)


def structural_intent(query: str) -> str | None:
    """'in', 'out' or None; case-sensitive, and incoming wins."""
    import re

    for intent, words in (("in", _CALLER_WORDS), ("out", _CALLEE_WORDS)):
        if re.search(rf"\b(?:{'|'.join(words)})\b".replace(" ", r"\s+"), query):
            return intent
    return None


def subject_words(query: str) -> list[str]:
    import re

    words: Iterable[str] = dict.fromkeys(w for w in re.split(r"[^A-Za-z0-9_.]+", query) if w)
    return sorted(words, key=len, reverse=True)
