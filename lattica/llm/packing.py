"""Operator 2: best-fit packing of documents into fixed-length sequences.

Lengths are small integers, so the plan depends on the corpus only through its length histogram (at
most ``capacity`` counts, whatever the corpus holds). The histogram is packed run by run, which gives
exactly the bins of one-by-one packing: items above a third of the capacity are matched greedily, at
most two to a bin; smaller items, longest first, go where they leave the least room. Documents then
find their bins through their rank among documents of the same length, which is an offset from a
small table of counts plus a rank inside one hash bucket, so that no task ever sees a whole length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.runtime import ship, stored

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.tiktoken"
BUCKETS = 1024


@lru_cache(maxsize=4)
def encoding(path: str):
    """Tokenizer of a public rank file, named or given as a path; set up once a process."""
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lattica", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(text: str, limit: int = 1 << 16) -> Iterator[str]:
    """A text in parts of bounded size that join to the whole, cut at line or word starts where it can."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind("\n", at + 1, at + limit), text.rfind(" ", at + 1, at + limit))
        cut = cut if cut > at else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_count(text: str | None, tokenizer: str = TOKENIZER) -> int:
    encode = encoding(tokenizer).encode_ordinary
    return sum(len(encode(part)) for part in pieces_of(text)) if text else 0


class Plan:
    """Runs of equal bins: the ``i``-th item of a run goes to bin ``bin + i // k`` at ``offset + i % k * length``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first bin, per bin, offset
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first bin, bins)
        self.next = dict.fromkeys(counts, 0)
        lengths = sorted((x for x in counts if counts[x]), reverse=True)
        self._match([x for x in lengths if 3 * x > capacity], dict(counts))
        for x in lengths:
            if 3 * x <= capacity:
                self._fit(x, counts[x])

    def _put(self, length: int, n: int, first: int, per_bin: int, room: int) -> None:
        """``n`` items of one length into bins from ``first`` on, each of which has ``room`` left."""
        self.runs.append((length, self.next[length], first, per_bin, self.capacity - room))
        self.next[length] += n
        full, rest = divmod(n, per_bin)
        if full:
            self._leave(room - per_bin * length, first, full)
        if rest:
            self._leave(room - rest * length, first + full, 1)

    def _leave(self, room: int, first: int, n: int) -> None:
        if room not in self.open:
            insort(self.gaps, room)
            self.open[room] = []
        self.open[room].append((first, n))

    def _new(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _match(self, large: list[int], left: dict[int, int]) -> None:
        """Longest first, each with the longest partner that still fits beside it."""
        rising = sorted(large)
        for x in large:
            while left[x]:
                i = bisect_left(rising, self.capacity - x + 1) - 1
                while i >= 0 and not left[rising[i]]:
                    rising.pop(i)
                    i -= 1
                y = rising[i] if i >= 0 else None
                if y == x:
                    if left[x] < 2:
                        y = next((rising[j] for j in range(i - 1, -1, -1) if left[rising[j]]), None)
                    else:
                        n = left[x] // 2
                        self._put(x, 2 * n, self._new(n), 2, self.capacity)
                        left[x] -= 2 * n
                        continue
                n = left[x] if y is None else min(left[x], left[y])
                first = self._new(n)
                left[x] -= n
                if y is None:
                    self._put(x, n, first, 1, self.capacity)
                else:
                    left[y] -= n
                    self.runs += [(x, self.next[x], first, 1, 0), (y, self.next[y], first, 1, x)]
                    self.next[x] += n
                    self.next[y] += n
                    self._leave(self.capacity - x - y, first, n)

    def _fit(self, x: int, n: int) -> None:
        while n:
            i = bisect_left(self.gaps, x)
            if i == len(self.gaps):
                per_bin = self.capacity // x
                self._put(x, n, self._new(-(-n // per_bin)), per_bin, self.capacity)
                return
            room = self.gaps[i]
            first, m = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.gaps.pop(i)
            per_bin = room // x
            used = min(m, -(-n // per_bin))
            if used < m:
                self._leave(room, first + used, m - used)
            now = min(n, used * per_bin)
            self._put(x, now, first, per_bin, room)
            n -= now

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        by: dict[int, list] = {}
        for x, *run in self.runs:
            by.setdefault(x, []).append(run)
        return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(r))) for x, r in by.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, piece, start, length, bin_id, bin_offset)``: where each piece of each document lies.

    A document longer than ``capacity`` tokens is cut into full pieces and a remainder, so ``piece``
    counts from 0 and ``start`` is its first token; pieces of a document may lie in different bins.
    Null and empty texts have one row of length 0 without a bin. Rows that repeat an id and a length
    are interchangeable and each get a place; a null id is packed like any other. An empty table gives
    no rows. Only ``doc_id`` and ``text`` are read, so further columns don't matter.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([token_count(t, tokenizer) for t in texts], dtype="int64")

    sizes = stored(docs.select("doc_id", tokens("text").alias("tokens")))
    full, rest = F.floor(F.col("tokens") / capacity).cast("long"), F.col("tokens") % capacity
    counts = {}
    for row in sizes.groupBy(rest.alias("rest")).agg(F.count("*").alias("n"), F.sum(full).alias("full")).collect():  # capacity rows at most
        counts[row.rest] = counts.get(row.rest, 0) + (row.n if row.rest else 0)
        counts[capacity] = counts.get(capacity, 0) + row.full
    whole = counts.pop(capacity, 0)  # full pieces fill bins alone, after the others
    plan = Plan({x: n for x, n in counts.items() if x and n}, capacity)
    runs, first_whole = plan.arrays(), plan.bins

    # Ranks: an offset for each (length, bucket), from counts alone, plus a rank inside the bucket.
    keyed = sizes.select(
        "doc_id", "tokens", rest.alias("rest"), full.alias("full"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    )
    totals = keyed.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("fulls"))
    offsets = totals.select(
        F.col("rest").alias("rest_"),
        F.col("bucket").alias("bucket_"),
        (F.sum("n").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("n")).alias("before"),
        (F.sum("fulls").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("fulls")).alias("fulls_before"),
    )
    per_rest = totals.groupBy(F.col("rest").alias("rest_all")).agg(F.sum("fulls").alias("fulls_all"))  # capacity rows at most
    base = per_rest.select("rest_all", (F.sum("fulls_all").over(Window.orderBy("rest_all")) - F.col("fulls_all")).alias("fulls_base"))
    inside = Window.partitionBy("rest", "bucket").orderBy("doc_id", "tokens")
    ranked = (
        keyed.withColumn("in_bucket", F.row_number().over(inside) - 1)
        .withColumn("fulls_in", F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
        .join(offsets, (F.col("rest") == F.col("rest_")) & (F.col("bucket") == F.col("bucket_")))
        .join(F.broadcast(base), F.col("rest") == F.col("rest_all"))
        .select(
            "doc_id", "tokens", "rest", "full",
            (F.col("before") + F.col("in_bucket")).alias("rank"),
            (F.col("fulls_base") + F.col("fulls_before") + F.col("fulls_in")).alias("full_rank"),
        )
    )

    @F.pandas_udf("bin long, at long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        x, r = lengths.to_numpy(dtype="int64"), ranks.to_numpy(dtype="int64")
        out = np.full((2, len(x)), -1, dtype="int64")
        for length in np.unique(x):
            if length in runs:
                rows = np.flatnonzero(x == length)
                first, first_bin, per_bin, offset = runs[length]
                k = np.searchsorted(first, r[rows], side="right") - 1
                i = r[rows] - first[k]
                out[0, rows] = first_bin[k] + i // per_bin[k]
                out[1, rows] = offset[k] + i % per_bin[k] * length
        return pd.DataFrame({"bin": out[0], "at": out[1]})

    spot = ranked.withColumn("spot", place("rest", "rank"))
    # ``spot`` is computed once a document; full pieces follow from their number alone.
    pieces = F.col("full") + F.when((F.col("rest") > 0) | (F.col("full") == 0), 1).otherwise(0)
    each = spot.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    is_full = F.col("piece") < F.col("full")
    return each.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"),
        F.when(is_full, F.lit(capacity)).otherwise(F.col("rest")).cast("int").alias("length"),
        F.when(is_full, F.lit(first_whole) + F.col("full_rank") + F.col("piece")).when(F.col("rest") > 0, F.col("spot.bin")).alias("bin_id"),
        F.when(is_full, F.lit(0)).when(F.col("rest") > 0, F.col("spot.at")).cast("int").alias("bin_offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
