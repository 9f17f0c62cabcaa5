"""Operator 5: benchmark decontamination by a prefix-filtered set join.

An item and an item-sized window of a document match when at least ``threshold`` of the item's
distinct word shingles lie in the window. An item of m shingles needs ``ceil(threshold * m)`` of them,
so any match holds at least one of its ``m - needed + 1`` rarest: only these prefix shingles are
joined, rarest first by how many documents of the corpus hold them. Length and position bounds then
discard candidates before the windows are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.textkernel import shingle_hashes, slices, word_hashes
from lattica.runtime import ship

WORDS = 5
THRESHOLD = 0.6
#: Shingles of the items of one part, some 32 bytes each where they are sent to the executors; see :func:`items_of`.
MOST_BROADCAST = 2_000_000


class Items:
    """The benchmark's shingle sets. Items of fewer than ``n`` words have one shingle, all their words."""

    def __init__(self, ids: list, texts: list, n: int = WORDS, threshold: float = THRESHOLD):
        words, offsets = word_hashes(texts)
        self.n, self.ids, self.sets, self.sizes = n, [], [], []
        for item, lo, hi in zip(ids, offsets[:-1], offsets[1:]):
            if hi > lo:
                size = min(n, int(hi - lo))
                self.ids.append(int(item))
                self.sets.append(np.unique(shingle_hashes(words[lo:hi], size)))
                self.sizes.append((size, int(hi - lo) - size + 1))  # words a shingle, shingles in a window
        self.needed = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        by_size: dict[int, list[int]] = {}
        for k, (size, _) in enumerate(self.sizes):
            by_size.setdefault(size, []).append(k)
        self.groups = {size: (ks, np.unique(np.concatenate([self.sets[k] for k in ks]))) for size, ks in by_size.items()}
        #: For each shingle size the prefix shingles, sorted, and the item of each.
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shingle size, the places in a document whose shingle is in some item."""
        for size, (_, known) in self.groups.items():
            own = shingle_hashes(words, size)
            if len(own):
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                place = np.flatnonzero(known[at] == own)
                if len(place):
                    yield size, place, own[place]

    def order(self, frequency: dict[int, int]) -> None:
        """Keep of each item the prefix that a match can't avoid, given document frequencies."""
        for size, (ks, _) in self.groups.items():
            hashes, items = [], []
            for k in ks:
                rare = sorted(self.sets[k].tolist(), key=lambda h: (frequency.get(h, 0), h))
                kept = rare[: len(rare) - self.needed[k] + 1]
                hashes.append(np.array(kept, dtype=np.uint64))
                items.append(np.full(len(kept), k, dtype=np.int32))
            flat, item = np.concatenate(hashes), np.concatenate(items)
            order = np.argsort(flat, kind="stable")
            self.prefix[size] = flat[order], item[order]

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, containment, first word) of the best window of each item that matches, by item."""
        out = []
        for size, place, held in self.hits(words):
            hashes, items = self.prefix[size]
            own = np.unique(held)
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            candidates = {k for i, j in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()) for k in items[i:j].tolist()}
            for k in candidates:
                mine = np.isin(held, self.sets[k])
                at, code = place[mine], held[mine]
                need, width = self.needed[k], self.sizes[k][1]
                if len(at) < need or len(words) - size + 1 < need:  # length bound
                    continue
                if not (at[need - 1 :] - at[: len(at) - need + 1] < width).any():  # position bound
                    continue
                best, first = _densest(at, code, width)
                if best >= need:
                    out.append((self.ids[k], best / len(self.sets[k]), int(first)))
        return sorted(out)


def _densest(at: np.ndarray, code: np.ndarray, width: int) -> tuple[int, int]:
    """Most distinct codes in any window of ``width`` places, and where the first such window's first hit is."""
    count: dict[int, int] = {}
    best, first, lo = 0, -1, 0
    places, codes = at.tolist(), code.tolist()
    for hi, p in enumerate(places):
        count[codes[hi]] = count.get(codes[hi], 0) + 1
        while places[lo] <= p - width:
            c = codes[lo]
            count[c] -= 1
            if not count[c]:
                del count[c]
            lo += 1
        if len(count) > best:
            best, first = len(count), places[lo]
    return best, first


def items_of(benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The benchmark in parts of about ``MOST_BROADCAST`` shingles; rows without id or text are left out.

    A benchmark is fixed while the corpus grows. Should it ever outgrow one part, the corpus is passed
    over once a part, which gives the same matches; the driver holds one part at a time. Item ids are
    whole numbers.
    """
    ship(benchmark.sparkSession)
    ids, texts, held = [], [], 0
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += row.text.count(" ") + row.text.count("\n") + 1
        if held >= MOST_BROADCAST:
            if (part := Items(ids, texts, n, threshold)).ids:
                yield part
            ids, texts, held = [], [], 0
    if ids and (part := Items(ids, texts, n, threshold)).ids:
        yield part


def _each(texts: pd.Series) -> Iterator[np.ndarray]:
    for first, last in slices(map(len, texts.fillna(""))):
        words, offsets = word_hashes(texts.iloc[first:last])
        yield from (words[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:]))


def ordered(docs: DataFrame, items: Items) -> Items:
    """``items`` with prefixes chosen by document frequency over all of ``docs``."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for batch in batches:
            for words in _each(batch["text"]):
                for _, _, held in items.hits(words):
                    for h in np.unique(held).view(np.int64).tolist():
                        total[h] = total.get(h, 0) + 1
        yield pd.DataFrame({"h": pd.Series(list(total), dtype="int64"), "n": pd.Series(list(total.values()), dtype="int64")})

    found = docs.select("text").mapInPandas(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()  # bounded by the items' shingles
    items.order(dict(zip(found["h"].to_numpy(dtype="int64").view(np.uint64).tolist(), found["n"].tolist())))
    return items


def matches(docs: DataFrame, items: Items) -> Column:
    """Column of ``array<struct(item_id, containment, word)>`` for ``text``."""
    ready = docs.sparkSession.sparkContext.broadcast(ordered(docs, items))  # bounded by MOST_BROADCAST

    @F.pandas_udf("array<struct<item_id:long,containment:double,word:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item_id": i, "containment": c, "word": w} for i, c, w in ready.value.matches(words)] for words in _each(texts)], dtype=object)

    return find(F.col("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, containment, word)`` for each document and item that match.

    ``word`` is the first word of the best window. Narrow but for the counts of the items' own
    shingles: texts are never shuffled. Null and empty texts and items match nothing; a repeated row
    is reported as often as it occurs, a repeated item once, and an item id with several texts once for
    each; texts of any length are read whole; an empty table on either side gives no rows. Only
    ``doc_id`` and ``text`` are read, so further columns don't matter.
    """
    parts = [
        docs.select("doc_id", F.explode(matches(docs, items)).alias("m")).select("doc_id", "m.item_id", "m.containment", "m.word")
        for items in items_of(benchmark, n, threshold)
    ]
    if not parts:
        empty = docs.sparkSession.createDataFrame([], "item_id long, containment double, word long")
        return docs.select("doc_id").limit(0).crossJoin(empty)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns and without a shuffle of texts."""
    for items in items_of(benchmark, n, threshold):
        docs = docs.where(F.size(matches(docs, items)) == 0)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT item_id, least({WORDS}, len(w)) AS k, unnest(list_distinct([array_to_string(w[i:i + least({WORDS}, len(w)) - 1], ' ')
         FOR i IN range(1, len(w) - least({WORDS}, len(w)) + 2)])) AS s, len(w) - least({WORDS}, len(w)) + 1 AS width
  FROM item_words WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS m FROM item_shingles GROUP BY item_id),
doc_shingles AS (
  SELECT doc_id, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc_words, (SELECT DISTINCT k FROM item_shingles) WHERE len(w) >= k)
), hits AS (SELECT d.doc_id, i.item_id, d.p, d.s, i.width FROM doc_shingles d JOIN item_shingles i USING (k, s)),
windows AS (
  SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.s) AS n
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.width
  GROUP BY a.doc_id, a.item_id, a.p
), best AS (SELECT doc_id, item_id, max(n) AS n FROM windows GROUP BY doc_id, item_id)
SELECT b.doc_id, b.item_id, b.n::DOUBLE / m AS containment,
       (SELECT min(w.p) FROM windows w WHERE w.doc_id = b.doc_id AND w.item_id = b.item_id AND w.n = b.n) AS word
FROM best b JOIN sizes USING (item_id) WHERE b.n >= ceil({THRESHOLD} * m - 1e-9)
"""
