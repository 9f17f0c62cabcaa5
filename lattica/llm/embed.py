"""Operator 9: embedding near-duplicates by an inverted multi-index.

The two halves of the unit vectors have codebooks of their own, and their product is the grid of cells
that vectors are filed in. A query visits cells by multi-sequence traversal, in rising order of a lower
bound on its distance to anything filed there. All queries go on ring by ring, each ring to twice the
bound of the last, until the recall is reached that is measured in the run: a sample of the vectors is
compared with all others by brute force. A ring that reaches the search radius itself is complete by
proof. Whatever is filed in a visited cell is compared exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.jaccard import components
from lattica.runtime import ship, stored

THRESHOLD = 0.95
PASSES = 4
PER_CELL = 16
TARGET = 0.98
#: Bounds of the rings as parts of the search radius.
RINGS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
#: The two codebooks are broadcast. They grow with the square root of the table (33 MB at 5e10 vectors of 64
#: coordinates); at this size they stop growing and the cells grow instead.
MOST_BOOK_BYTES = 1 << 26
BLOCK = 1024
#: Vectors of a cell that one task holds together; a cell of more is filed in slots, and its queries go to each.
SLOT = 4096
#: Vectors compared with all others to measure the recall, and how many pairs of theirs make a measurement; where
#: there are fewer, each gets a made-up neighbour right at the threshold, and the share of those found is the measure.
SAMPLE, LEAST_PAIRS = 1024, 20


def _unit(rows: pd.Series, dim: int) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _square(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :], 0.0)


def codebooks(vectors: DataFrame, dim: int, codes: int, passes: int = PASSES) -> list[np.ndarray]:
    """Lloyd's algorithm on both halves at once, over all vectors; each pass sends ``2 * codes`` sums a task."""
    half = dim // 2
    seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(codes).toPandas()
    start = _unit(seeds["v"], dim)
    books = [np.unique(start[:, :half], axis=0), np.unique(start[:, half:], axis=0)]
    for _ in range(passes):

        def sums(batches: Iterator[pd.DataFrame], books=tuple(books)) -> Iterator[pd.DataFrame]:
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
            for batch in batches:
                x = _unit(batch["v"], dim)
                for k, (book, part) in enumerate(zip(books, (x[:, :half], x[:, half:]))):
                    near = _square(part, book).argmin(1)
                    np.add.at(total[k], near, np.hstack([part, np.ones((len(part), 1))]))
            yield pd.DataFrame([{"side": k, "code": i, "sums": row.tolist()} for k, t in enumerate(total) for i, row in enumerate(t) if row[-1]], columns=["side", "code", "sums"])

        parts = vectors.select("v").mapInPandas(sums, "side int, code int, sums array<double>")
        spread = parts.select("side", "code", F.posexplode("sums").alias("i", "x")).groupBy("side", "code", "i").agg(F.sum("x").alias("x"))
        rows = spread.groupBy("side", "code").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("sums")).collect()
        for r in rows:
            s = [c.x for c in r.sums]
            books[r.side][r.code] = np.array(s[:-1]) / s[-1]
    return books


class Grid:
    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def cells(self, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        u, v = (_square(x, b).argmin(1) for x, b in zip(halves, self.books))
        return u.astype(np.int64) * len(self.books[1]) + v

    def bounds(self, side: int, x: np.ndarray) -> np.ndarray:
        """At least how far each query's half is from anything filed under each code.

        What lies nearer to code c than to the query's own code is beyond the plane between the two.
        """
        book = self.books[side]
        d = _square(x, book)
        own = d.argmin(1)
        codes, place = np.unique(own, return_inverse=True)
        gap = np.sqrt(_square(book[codes], book))[place]
        gap[np.arange(len(x)), own] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap)
        far[gap == 0] = 0.0
        return np.maximum(far - 1e-9, 0.0)

    def visits(self, halves: tuple[np.ndarray, np.ndarray], inner: float, outer: float) -> list[list[int]]:
        """Cells of each query in the ring, by multi-sequence traversal: bound above ``inner``, up to ``outer``."""
        a, b = (self.bounds(k, x) for k, x in enumerate(halves))
        floor, limit, width, out = inner**2 if inner >= 0 else -1.0, outer**2, len(self.books[1]), []
        for p, q in zip(a, b):
            i_order, j_order = (np.flatnonzero(r <= outer)[np.argsort(r[r <= outer], kind="stable")] for r in (p, q))
            x, y = (p[i_order] ** 2).tolist(), (q[j_order] ** 2).tolist()
            heap, seen, cells = [(x[0] + y[0], 0, 0)], {(0, 0)}, []
            while heap and heap[0][0] <= limit:
                bound, i, j = heapq.heappop(heap)
                if bound > floor:
                    cells.append(int(i_order[i]) * width + int(j_order[j]))
                for i2, j2 in ((i + 1, j), (i, j + 1)):
                    if i2 < len(x) and j2 < len(y) and (i2, j2) not in seen:
                        seen.add((i2, j2))
                        heapq.heappush(heap, (x[i2] + y[j2], i2, j2))
            out.append(cells)
        return out


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", per_cell: int = PER_CELL, target: float = TARGET) -> DataFrame:
    """``(a, b, cosine)`` with a < b for every pair of vectors of cosine similarity at least ``threshold``.

    ``threshold`` must be in (0, 1]. Rows with a null id, a null, empty or zero vector, a null or
    non-finite coordinate, or another length than most rows have are in no pair; rows that repeat an id
    and vector count once and make no pair with each other. Fewer than two usable rows give none.
    Only the two named columns are read. Cosines are computed in double precision, a cosine right at the
    threshold counts, and a pair is looked for from both sides. Any number of equal vectors may share a
    cell; every pair of them is a row.
    """
    ship(table.sparkSession)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("v", lambda x: F.abs(x) > 1e-30)).distinct()
    vectors = stored(rows)
    sizes = sorted(((r["count"], r.n) for r in vectors.groupBy(F.size("v").alias("n")).count().collect()), reverse=True)  # a row a length
    spark = table.sparkSession
    if not sizes or sizes[0][0] < 2:
        return spark.createDataFrame([], "a long, b long, cosine double")
    count, dim = sizes[0]
    if dim < 2:  # one coordinate: equal signs are parallel
        x, y = (vectors.where(F.size("v") == dim).select(F.col("id").alias(n), F.signum(F.col("v")[0]).alias("s")) for n in "ab")
        return x.join(y, "s").where("a < b").select("a", "b", F.lit(1.0).alias("cosine")).distinct()
    vectors = vectors.where(F.size("v") == dim)
    codes = max(1, min(MOST_BOOK_BYTES // (8 * dim), 1 << round(math.log2(max(1.0, math.sqrt(count / per_cell))))))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    grid = Grid(codebooks(vectors, dim, codes))
    half = dim // 2
    shared = spark.sparkContext.broadcast(grid)  # two books, at most MOST_BOOK_BYTES together
    # Vectors travel as they came, so nothing is lost to rounding before they are compared.
    kind = np.float32 if isinstance(table.schema[vector].dataType.elementType, T.FloatType) else np.float64

    def unit(raw: pd.Series) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = pd.Series([np.asarray(v, dtype=kind).tobytes() for v in batch["v"]], dtype=object)
            x = unit(raw) if len(raw) else np.zeros((0, dim))
            yield pd.DataFrame({"cell": shared.value.cells((x[:, :half], x[:, half:])), "id": batch["id"].to_numpy(), "v": raw})

    residents = stored(vectors.mapInPandas(filed, "cell long, id long, v binary"))
    slots = stored(residents.groupBy("cell").count().where(F.col("count") > SLOT).select("cell", F.ceil(F.col("count") / SLOT).cast("int").alias("slots")))
    crowded = not slots.isEmpty()
    if crowded:
        filed_in = residents.join(slots, "cell", "left").withColumn("slot", F.pmod(F.xxhash64("id"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
    else:
        filed_in = residents.withColumn("slot", F.lit(0))

    sample = residents.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toPandas()
    asked_ids, asked_x = sample["id"].to_numpy(), unit(sample["v"])

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, x = batch["id"].to_numpy(), unit(batch["v"])
            for at in range(0, len(x), BLOCK):
                c = asked_x @ x[at : at + BLOCK].T
                i, j = np.nonzero((c >= threshold) & (c < 1 - 1e-9) & (asked_ids[:, None] != ids[None, at : at + BLOCK]))
                a, b = asked_ids[i], ids[at + j]
                yield pd.DataFrame({"q": a, "a": np.minimum(a, b), "b": np.maximum(a, b)})

    # Pairs of different vectors alone: identical ones share a cell and would hide what near ones lack.
    known = stored(residents.select("id", "v").mapInPandas(brute, "q long, a long, b long").distinct())

    def measured(found: DataFrame) -> float | None:
        """The less of the share of the sample's pairs that was found and of its mean over vectors; None where they are too few."""
        hit = known.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
        r = hit.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.avg(F.col("h") / F.col("n")).alias("mean")).first()
        return None if (r.n or 0) < LEAST_PAIRS else min(r.h / r.n, r.mean)

    def planted(outer: float) -> float:
        """Share of made-up pairs of a cosine right at the threshold, one for each sampled vector, that the rings up to ``outer`` find from either side."""
        noise = np.random.default_rng(977).normal(size=asked_x.shape)
        noise -= (noise * asked_x).sum(1)[:, None] * asked_x
        other = threshold * asked_x + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        hits = []
        for at in range(0, len(other), 64):  # few at once, as this is the driver
            sides = [(x[at : at + 64, :half], x[at : at + 64, half:]) for x in (asked_x, other)]
            seen = [grid.visits(x, -1.0, outer) for x in sides]
            hits += [b in p or a in q for a, b, p, q in zip(grid.cells(sides[0]), grid.cells(sides[1]), *seen)]
        return float(np.mean(hits))

    def ring(inner: float, outer: float) -> DataFrame:
        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    part = batch.iloc[at : at + BLOCK]
                    x = unit(part["v"])
                    cells = shared.value.visits((x[:, :half], x[:, half:]), inner, outer)
                    n = [len(c) for c in cells]
                    flat = np.fromiter((c for own in cells for c in own), np.int64, sum(n))
                    yield pd.DataFrame({"cell": flat, "id": np.repeat(part["id"].to_numpy(), n), "v": np.repeat(part["v"].to_numpy(), n)})

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows of one slot of a cell follow each other, residents before queries; both are taken in blocks."""
            cell, ids, held = None, [], []
            for batch in batches:
                cells, rows, asks, own_ids = batch["cell"].to_numpy(), batch["slot"].to_numpy(), batch["asks"].to_numpy(dtype=bool), batch["id"].to_numpy()
                cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (rows[1:] != rows[:-1]) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(cells)]))):
                    if lo == hi:
                        continue
                    if (cells[lo], rows[lo]) != cell:
                        cell, ids, held = (cells[lo], rows[lo]), [], []
                    if not asks[lo]:
                        ids.append(own_ids[lo:hi])
                        held.append(unit(batch["v"].iloc[lo:hi]))
                        continue
                    for at in range(lo, hi, BLOCK) if held else ():
                        to = min(at + BLOCK, hi)
                        q, q_ids = unit(batch["v"].iloc[at:to]), own_ids[at:to]
                        for r_ids, r in zip(ids, held):
                            for k in range(0, len(r), BLOCK):
                                c = q @ r[k : k + BLOCK].T
                                i, j = np.nonzero((c >= threshold) & (q_ids[:, None] != r_ids[None, k : k + BLOCK]))
                                if len(i):
                                    x, y = q_ids[i], r_ids[k + j]
                                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": np.minimum(c[i, j], 1.0)})

        queries = residents.select("id", "v").mapInPandas(asked, "cell long, id long, v binary")
        if crowded:
            queries = queries.join(slots, "cell", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        else:
            queries = queries.withColumn("slot", F.lit(0))
        both = queries.withColumn("asks", F.lit(True)).unionByName(filed_in.withColumn("asks", F.lit(False)))
        return both.repartition("cell", "slot").sortWithinPartitions("cell", "slot", "asks").mapInPandas(verify, "a long, b long, cosine double")

    found, inner = None, -1.0
    for part in RINGS:
        outer = part * radius
        now = ring(inner, outer)
        every = now if found is None else found.unionByName(now)
        found = stored(every.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
        inner, share = outer, measured(found)
        if (planted(outer) if share is None else share) >= target:
            break
    return found


def linked(table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """``(vec_id, class_id, links)``: a row an id, the least id of its class, and how many other ids it is linked to.

    Ids are linked where ``near_vectors`` gives a pair, and a class is what links connect. Ids without a usable
    vector are a class of their own without links; rows with a null id are left out.
    """
    pairs = near_vectors(table, threshold, key, vector, target=target).select("a", "b")
    both = pairs.select(F.col("a").alias("vec_id")).unionByName(pairs.select(F.col("b").alias("vec_id")))
    links = both.groupBy("vec_id").agg(F.count("*").alias("links"))
    classes = components(pairs).select(F.col("node").alias("vec_id"), F.col("root").alias("class_id"))
    ids = table.select(F.col(key).cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    whole = ids.join(classes, "vec_id", "left").join(links, "vec_id", "left")
    return whole.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
l AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS other FROM v WHERE id IS NOT NULL UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT id, min(other) AS class_id FROM r GROUP BY id),
k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT c.id AS vec_id, c.class_id, coalesce(k.links, 0) AS links FROM c LEFT JOIN k ON k.x = c.id
"""
