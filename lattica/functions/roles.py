"""Injected model roles: any callable can summarise files, name clusters or merge batches.

Each role is an ordinary Python callable given by the user and run in Arrow batches beside the data;
nothing here talks to a network. A gate stops a pass after a terminal error or a run of failures, and
the rows that it left are counted as skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.runtime import ship

FILE_CHARS, BATCH_CHARS, MOST_FAILURES, ATTEMPTS = 24_000, 60_000, 5, 2


class Terminal(Exception):
    """An error that no retry mends, such as a refused key."""


class FailureGate:
    """Closed by a terminal error or five failures in a row; a success opens the count anew."""

    def __init__(self, most: int = MOST_FAILURES):
        self.most, self.failures, self.closed = most, 0, False

    def run(self, call: Callable, *args):
        """``(result, outcome)`` with the outcome ok, failed or skipped."""
        if self.closed:
            return None, "skipped"
        try:
            out = call(*args)
        except Terminal:
            self.closed = True
            return None, "failed"
        except Exception:  # the role's own errors, whatever they are
            self.failures += 1
            self.closed = self.failures >= self.most
            return None, "failed"
        self.failures = 0
        return out, "ok"


def summarise(files: DataFrame, role: Callable[[str, str], str], most: int = FILE_CHARS) -> DataFrame:
    """``(path, summary, outcome)`` of files ``(path, text)``; a gate a task."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = FailureGate()
        for batch in batches:
            rows = [(p, *gate.run(role, (t or "")[:most], p)) for p, t in zip(batch["path"], batch["text"])]
            yield pd.DataFrame(rows, columns=["path", "summary", "outcome"])

    return files.select("path", "text").mapInPandas(run, "path string, summary string, outcome string")


def cached(keyed: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(key, value)`` of all keys: cached ones replayed, the others computed."""
    misses = keyed.join(cache.select("key"), "key", "left_anti")
    return cache.join(keyed.select("key"), "key", "left_semi").select("key", "value").unionByName(compute(misses).select("key", "value"))


def describe_symbols(files: DataFrame, role: Callable[[str, str, list[str]], dict[str, str]], attempts: int = ATTEMPTS) -> DataFrame:
    """``(path, id, summary)`` for files ``(path, text, ids)``; what an answer leaves out is asked for again."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = FailureGate()
        for batch in batches:
            rows = []
            for path, text, ids in zip(batch["path"], batch["text"], batch["ids"]):
                wanted, found = list(ids), {}
                for _ in range(attempts):
                    left = [i for i in wanted if i not in found]
                    if left:
                        answer, _outcome = gate.run(role, text, path, left)
                        found |= {i: s for i, s in (answer or {}).items() if i in wanted}
                rows += [(path, i, found[i]) for i in wanted if i in found]
            yield pd.DataFrame(rows, columns=["path", "id", "summary"])

    return files.select("path", "text", "ids").mapInPandas(run, "path string, id string, summary string")


def linked_concepts(concepts: DataFrame) -> DataFrame:
    """``(slug, to, relation)`` of links by name: case folded, self links dropped, each once."""
    known = concepts.select(F.lower(F.trim("name")).alias("_key"), F.col("slug").alias("to"))
    links = concepts.select("slug", F.explode("links").alias("l")).select("slug", F.lower(F.trim("l.to")).alias("_key"), F.col("l.relation").alias("relation"))
    return links.join(known, "_key").where("slug <> to").select("slug", "to", "relation").distinct()


def inherited_sources(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """``(slug, path)``: own sources, or for concepts without any those of concepts they link to, one step."""
    own = concepts.select("slug", F.explode("sources.path").alias("path")).distinct()
    bare = concepts.select("slug").join(own.select("slug").distinct(), "slug", "left_anti")
    lent = links.join(bare, "slug").select("slug", F.col("to").alias("_to")).join(own.select(F.col("slug").alias("_to"), "path"), "_to").select("slug", "path")
    return own.unionByName(lent.distinct())
