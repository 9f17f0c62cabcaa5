"""Operator 6: n-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Every document has one label a tree: ``DEPTH`` minimum hashes in a row. The labels of a tree, in order,
are its prefix tree: the longest prefix that a label shares with any other is that with a neighbour. The
labels are sorted once, and those that no other meets even at the shortest prefix that could be needed
are gone from then on. The search starts with the longest prefixes and shortens them until the recall
estimated from what was found (each pair weighted by the inverse of its chance to be found at that
depth) reaches the target, among the least similar pairs that count and among all. Candidates are then
compared by their whole shingle sets.

Documents with the same shingle set are one node throughout, so copies cost nothing in the search.

``near_pairs`` returns every pair, whose number grows with the square of a group of near copies. ``linked`` and
``one_of_each`` need classes and counts alone, and don't list pairs. Under each prefix of ``floor_depth`` hashes
all nodes are first compared with the least one, which joins most of a group; after that only nodes of different
classes under one prefix are compared with each other, so the classes are those of all candidates. The latter, and
the links between all nodes of a class, are found block by block, as products of shingle matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.textkernel import shingle_sets, slices
from lattica.runtime import fresh_name, ship, stored

WORDS, THRESHOLD = 3, 0.55
TREES, DEPTH, TARGET = 32, 5, 0.95
#: Candidates whose sketches are this far under the threshold aren't compared. An estimate by sketches has a
#: standard error of 0.05, so a pair right at the threshold is left out with a chance of 3 in 100,000.
SLACK = 0.2
#: Ids up to this count (some 50 MB) are broadcast to pick out the texts to verify; beyond it they are joined by a
#: shuffle. The result is the same.
MOST_BROADCAST = 2_000_000
#: Nodes under one prefix that are paired in one task; larger crowds are paired block by block.
CROWD = 2_000
#: Bytes of shingle sets in a block; the pairs of a component are compared by pairs of its blocks.
BLOCK_BYTES = 1 << 25
LIST = 1000
#: Bytes of shingle sets in a block whose links are counted by one task, and rows and shingles of one product.
LINK_BYTES, LINK_ROWS, LINK_SHINGLES = 1 << 23, 512, 4096

_FACTORS = np.random.default_rng(4242).integers(1, 1 << 63, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``TREES * DEPTH`` 32-bit minimum hashes of each non-empty set."""
    out = np.zeros((len(sets), len(_FACTORS)), dtype=np.uint32)
    at = 0
    while at < len(sets):  # blocks that stay in the processor's cache
        to, size = at, 0
        while to < len(sets) and (size == 0 or size + len(sets[to]) <= 32768):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : to - 1]]))).astype(np.int64)
        held = np.empty_like(x)
        for i, factor in enumerate(_FACTORS):
            np.multiply(x, factor, out=held)
            out[at:to, i] = np.minimum.reduceat(held, starts) >> np.uint64(32)
        at = to
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each minimum hash, four to a byte."""
    low = (sig & 3).astype(np.uint8).reshape(len(sig), sig.shape[1] // 4, 4)
    return low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with the shingle sets of their texts."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        for lo, hi in slices(lengths):
            part = batch.slice(lo, hi - lo)
            yield part, shingle_sets(part.column("text").to_pylist(), WORDS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _text_slices(batches):
        rows = [i for i, s in enumerate(sets) if len(s)]
        own = [sets[i] for i in rows]
        sig = signatures(own) if own else np.zeros((0, TREES * DEPTH), np.uint32)
        keys = [set_key(s) for s in own]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([node_of(k) for k in keys], pa.int64()),
                pa.array([len(x) for x in own], pa.int64()),
                pa.array([row.tobytes() for row in sig], pa.binary()),
                pa.array([row.tobytes() for row in sketches(sig)], pa.binary()),
            ],
            names=["doc_id", "key", "node", "size", "sig", "sketch"],
        )


def found_chance(j: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Chance that a pair of Jaccard similarity j shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - np.asarray(j) ** depth) ** TREES


def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity by the share of equal hashes in two sketches, less those equal by chance."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    differ = x ^ y
    unequal = (differ | differ >> 1) & 0x55
    equal = 1 - np.bitwise_count(unequal).sum(axis=1) / (4 * x.shape[1])
    return pd.Series((equal - 0.25) / 0.75)


def floor_depth(threshold: float, target: float) -> int:
    """The longest prefix at which a pair right at the threshold is found with the target chance."""
    return next((k for k in range(DEPTH, 1, -1) if found_chance(threshold, k) >= target), 1)


def tries(signed: DataFrame, floor: int) -> DataFrame:
    """``(node, bucket, tail_*, told_*, reach)`` of each label that another node's meets at ``floor`` hashes or more.

    ``bucket`` is the tree and the first ``floor`` hashes, ``tail_k`` the k-th hash, ``reach`` the longest
    prefix that a neighbour in the sorted tree shares, and ``told_k`` holds the labels of the two trees
    before at depth k, so that a pair is told once for each run of trees that it shares.
    """
    at, levels, trees = f"t * {4 * DEPTH} + 1", range(floor, DEPTH + 1), f"sequence(0, {TREES - 1})"
    heads = F.expr(f"transform({trees}, t -> xxhash64(t, substring(sig, {at}, {4 * floor})))").alias("h")
    tails = [F.expr(f"transform({trees}, t -> xxhash64(substring(sig, {at} + {4 * (k - 1)}, 4)))").alias(f"x_{k}") for k in levels[1:]]
    each = signed.select("node", heads, *tails).select("*", F.expr(f"explode({trees})").alias("t"))

    def told(k: int) -> Column:
        label = f"xxhash64(h[t - {{0}}], {', '.join(['0', *(f'x_{i}[t - {{0}}]' for i in range(floor + 1, k + 1))])})"
        before = [f"((CASE WHEN t >= {d} THEN {label.format(d)} ELSE xxhash64(node, {d}) END) & 4294967295L)" for d in (1, 2)]
        return F.expr(f"shiftleft({before[0]}, 32) | {before[1]}").alias(f"told_{k}")

    labels = each.select("node", F.expr("h[t]").alias("bucket"), *[F.expr(f"x_{k}[t]").alias(f"tail_{k}") for k in levels[1:]], *[told(k) for k in levels])
    # Copies fall together after the one shuffle by bucket, which the sort needs anyway.
    once = labels.repartition("bucket").dropDuplicates(["bucket", "node"])
    order = Window.partitionBy("bucket").orderBy(*[f"tail_{k}" for k in levels[1:]], "node")

    def shared(neighbour) -> Column:
        depth, same = F.when(neighbour("node").isNull(), 0).otherwise(F.lit(floor)), F.lit(True)
        for k in levels[1:]:
            same = same & F.coalesce(neighbour(f"tail_{k}") == F.col(f"tail_{k}"), F.lit(False))
            depth = depth + F.when(same, 1).otherwise(0)
        return depth

    reach = F.greatest(shared(lambda c: F.lag(c).over(order)), shared(lambda c: F.lead(c).over(order)))
    return stored(once.withColumn("reach", reach).where(F.col("reach") > 0))


def _level(trie: DataFrame, floor: int, depth: int, deeper: bool) -> DataFrame:
    """``(a, b)`` of the node pairs whose labels share ``depth`` hashes, and no more if ``deeper`` ones are known."""
    key = F.col("bucket") if depth == floor else F.xxhash64("bucket", *[f"tail_{k}" for k in range(floor + 1, depth + 1)])
    beyond = F.col(f"tail_{depth + 1}") if deeper else F.lit(None).cast("long")
    rows = trie.where(F.col("reach") >= depth).select("node", key.alias("key"), F.col(f"told_{depth}").alias("told"), beyond.alias("beyond"))
    group = Window.partitionBy("key")
    blocks = F.ceil(F.count("*").over(group) / CROWD).cast("int")
    # A crowd is cut into blocks by its nodes' hashes, and each pair of blocks is a group of its own.
    sized = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        x = left.select(F.col("node").alias("a"), *on, F.col("told").alias("told_a"), F.col("beyond").alias("beyond_a"))
        y = right.select(F.col("node").alias("b"), *on, F.col("told").alias("told_b"), F.col("beyond").alias("beyond_b"))
        both = F.col("told_a").bitwiseXOR(F.col("told_b"))
        fresh = (F.shiftrightunsigned(both, 32) != 0) & (both.bitwiseAND(F.lit(0xFFFFFFFF)) != 0) & ~F.coalesce(F.col("beyond_a") == F.col("beyond_b"), F.lit(False))
        return x.join(y, on).where(fresh)

    few = sized.where("blocks = 1")
    crowds = sized.where("blocks > 1")
    left = crowds.select("*", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")).withColumn("i", F.col("block"))
    right = crowds.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("i")).withColumn("j", F.col("block"))
    pairs = paired(few, few, ["key"]).where("a < b").select("a", "b")
    crowded = paired(left, right, ["key", "i", "j"]).where("i < j OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(crowded).distinct()


def forest(signed: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Candidates ``(a, b, guess)`` at the longest prefixes that reach the target recall.

    Prefixes are shortened from ``DEPTH`` while the pairs found, each weighted by the inverse of its chance
    to be found, say that too many of the least similar or of all were missed, or while nothing was found;
    at ``floor_depth`` every pair that counts is found with the target chance, whatever the estimate.
    """
    floor = floor_depth(threshold, target)
    trie = tries(signed, floor)
    own = signed.groupBy("node").agg(F.first("sketch").alias("sketch"))
    found = None
    for depth in range(DEPTH, floor - 1, -1):
        fresh = _level(trie, floor, depth, found is not None)
        if found is not None:
            fresh = fresh.join(found.select("a", "b"), ["a", "b"], "left_anti")
        guessed = (
            fresh.join(own.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
            .select("a", "b", F.pandas_udf(_estimate, "double")("sketch_a", "sketch_b").alias("guess"))
        )
        kept = guessed.where(F.col("guess") >= threshold - SLACK)
        found = stored(kept if found is None else found.unionByName(kept))
        if depth == floor or recall(found, depth, threshold) >= target:
            return found


def recall(pairs: DataFrame, depth: int, threshold: float) -> float:
    """Estimated share of the pairs that count that is found at ``depth``: the less of all and of the least similar; 0 where none was found."""
    seen = pairs.where(F.col("guess") >= threshold).groupBy(F.least(F.floor((F.col("guess") - threshold) * 10), F.lit(4)).alias("band"))
    chance = 1 - F.pow(1 - F.pow(F.least("guess", F.lit(1.0)), F.lit(float(depth))), F.lit(float(TREES)))
    bands = sorted(seen.agg(F.count("*").alias("n"), F.sum(1 / chance).alias("there")).collect())  # five rows at most
    return min(bands[0].n / bands[0].there, sum(b.n for b in bands) / sum(b.there for b in bands)) if bands else 0.0


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of undirected pairs ``(a, b)``; the root is the least node.

    Every node hooks onto its least neighbour, the hooks are followed to their ends, and the pairs
    between different ends are the next, far smaller graph. Dense groups vanish in the first round.
    """
    edges, whole = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        down = edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))
        hooks = stored(down.groupBy("node").agg(F.min("root").alias("root")).select("node", F.least("node", "root").alias("root")))
        while True:  # pointer jumping over nodes
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            jumped = stored(hooks.join(further, "root").select("node", F.col("root").alias("old"), F.col("beyond").alias("root")))
            hooks = jumped.select("node", "root")
            if jumped.where("old <> root").isEmpty():
                break
        ends = hooks.select(F.col("node").alias("u"), F.col("root").alias("x"))
        others = hooks.select(F.col("node").alias("v"), F.col("root").alias("y"))
        between = edges.join(ends, "u").join(others, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        edges = stored(between)
        if whole is None:
            whole = hooks
        else:
            moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("to"))
            whole = stored(whole.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        if edges.isEmpty():
            return whole


def _overlap(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group follow each other, sets (b is null) before pairs."""
        group, held = None, {}
        for batch in batches:
            out: list[tuple] = []
            for r, i, j, a, b, own in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "a", "b", "own"))):
                if (r, i, j) != group:
                    group, held = (r, i, j), {}
                if b is None:
                    held[a] = own
                elif a in held and b in held and (similarity := _overlap(held[a], held[b])) >= threshold:
                    out.append((a, b, similarity))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "jaccard"])

    return verify


def _sets(*carried: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _text_slices(batches):
            same = [i for i, (s, key) in enumerate(zip(sets, part.column("key").to_pylist())) if len(s) and set_key(s) == key]
            pick = pa.array(same, pa.int64())
            columns = [part.column(c).take(pick) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in same], pa.binary())], names=[*carried, "own"])

    return made


def one_node_a_key(signed: DataFrame, turn: int = 0) -> DataFrame:
    """``signed`` with another node for each key whose first 64 bits are those of a lesser key.

    Of n sets some n * n / 2**65 share them, 70 of fifty thousand million: few enough to be collected.
    """
    keys = signed.groupBy("node").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("node", "least")
    clashes = signed.select("node", "key").join(keys, "node").where("key <> least").select("key").distinct().collect()
    if not clashes:
        return signed
    moved = signed.sparkSession.createDataFrame([(bytes(r.key), int.from_bytes(hashlib.blake2b(bytes(r.key) + bytes([turn]), digest_size=8).digest(), "little", signed=True)) for r in clashes], "key binary, other long")
    again = signed.join(F.broadcast(moved), "key", "left").withColumn("node", F.coalesce("other", "node")).select(*signed.columns)
    return one_node_a_key(stored(again), turn + 1)


def _texts_signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ship(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts, one_node_a_key(stored(texts.mapInArrow(_signed, "doc_id long, key binary, node long, size long, sig binary, sketch binary")))


def node_pairs(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """Members ``(doc_id, node)`` and verified pairs ``(a, b, jaccard)`` of nodes.

    A node is a distinct shingle set, told apart by 128 bits of its digest.
    """
    texts, signed = _texts_signed(docs)
    members = signed.select("doc_id", "node").distinct()
    pairs = forest(signed, threshold, target)
    roots = components(pairs)
    # The least id of a node stands for its text when the sets are made again.
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("size").alias("size")).join(roots, "node")
    counted = roots.join(signed.select("node", "size").distinct(), "node").groupBy("root").agg(F.ceil(F.sum(8 * F.col("size")) / BLOCK_BYTES).cast("int").alias("blocks"))
    wanted = stored(nodes.drop("size").join(counted, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    few = wanted.count() <= MOST_BROADCAST
    owned = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").mapInArrow(_sets("root", "node", "block", "blocks"), "root long, node long, block int, blocks int, own binary")
    place = wanted.select("node", "root", "block")
    placed = pairs.join(place.withColumnRenamed("node", "a").withColumnRenamed("block", "x"), "a").join(place.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("ij")
    sets = owned.select("root", F.col("node").alias("a"), "own", others).select("root", "ij.i", "ij.j", "a", F.lit(None).cast("long").alias("b"), "own")
    asked = placed.select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b", F.lit(None).cast("binary").alias("own"))
    verified = (
        sets.unionByName(asked)
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j", F.col("b").asc_nulls_first())
        .mapInArrow(_verified(threshold), "a long, b long, jaccard double")
    )
    return members, stored(verified)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``(doc_a, doc_b, jaccard)`` with ``doc_a < doc_b``: every pair of documents at or above ``threshold``.

    Similarities are exact; the search finds a pair with a chance of at least ``target``, less the 3 in
    100,000 of ``SLACK``, and identical shingle sets always. Documents of one or two words have one
    shingle, their whole text; null ids and null or wordless texts are in no pair; rows that repeat an id
    make no pair with each other, and where an id has several texts a pair has the greatest similarity
    among them; texts of any length are read whole; an empty table gives no rows. Ids are whole numbers.
    Only ``doc_id`` and ``text`` are read, so further columns don't matter.
    """
    members, pairs = node_pairs(docs, threshold, target)
    # Copies travel as lists of about a thousand ids, so that pairs of them are written, never shuffled.
    counted = members.withColumn("n", F.count("*").over(Window.partitionBy("node")))
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / LIST))
    chunked = counted.withColumn("chunk", chunk).groupBy("node", "n", "chunk").agg(F.collect_list("doc_id").alias("ids"))
    chunked = stored(chunked)
    left = chunked.select(F.col("node").alias("a"), "n", F.col("ids").alias("x"))
    right = chunked.select(F.col("node").alias("b"), F.col("ids").alias("y"))
    across = pairs.join(left, "a").join(right, "b").select("jaccard", F.explode("x").alias("x"), "y").select("jaccard", "x", F.explode("y").alias("y")).where("x <> y")
    same = left.where("n > 1").join(right, F.col("a") == F.col("b")).select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).where("x < y")
    ordered = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    every = ordered.unionByName(same.select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard")))
    if members.groupBy("doc_id").count().where("count > 1").isEmpty():
        return every
    return every.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def led(signed: DataFrame, floor: int) -> DataFrame:
    """``(bucket, node, leader)`` of the nodes that share a prefix of ``floor`` hashes with a lesser one, the least of them the leader."""
    at, trees = f"t * {4 * DEPTH} + 1", f"sequence(0, {TREES - 1})"
    nodes = signed.groupBy("node").agg(F.first("sig").alias("sig"))
    each = nodes.select("node", F.explode(F.expr(f"transform({trees}, t -> xxhash64(t, substring(sig, {at}, {4 * floor})))")).alias("bucket"))
    under = each.withColumn("leader", F.min("node").over(Window.partitionBy("bucket")))
    return stored(under.where("node <> leader"))


def _alike(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The distinct ``(a, b)`` whose sketches aren't ``SLACK`` under the threshold."""
    own = signed.groupBy("node").agg(F.first("sketch").alias("sketch"))
    x, y = (own.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    guessed = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", F.pandas_udf(_estimate, "double")("sketch_a", "sketch_b").alias("guess"))
    return stored(guessed.where(F.col("guess") >= threshold - SLACK).select("a", "b"))


def _with_sets(texts: DataFrame, signed: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """``wanted`` nodes, with their columns of ``schema``, and the shingle set ``own`` of each, made again from the text of its least id."""
    stands = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("key").alias("key"))
    chosen = stored(wanted.join(stands, "node"))
    few = chosen.count() <= MOST_BROADCAST
    carried = [c.split()[0] for c in schema.split(", ")]
    return texts.join(F.broadcast(chosen) if few else chosen, "doc_id").mapInArrow(_sets(*carried), f"{schema}, own binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity reaches the threshold; the set of each b is sent to its a."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_with_sets(texts, signed, nodes, "node long"))
    firsts = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "own")
    seconds = pairs.join(sets.withColumnRenamed("node", "b"), "b").select("a", "b", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, b""
        for batch in batches:
            kept = []
            for i, (a, b, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "own")))):
                if b is None:
                    first, held = a, own
                elif a == first and _overlap(held, own) >= threshold:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return stored(firsts.unionByName(seconds).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long"))


def classes(texts: DataFrame, signed: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``(node, root)`` of the nodes that some link joins to another; nodes of a class have the same root.

    The classes are those that all links among the nodes under common prefixes make: every such pair is
    compared, or its nodes are known to be of one class already.
    """
    under = led(signed, floor_depth(threshold, target))
    links = _confirmed(_alike(under.select(F.col("leader").alias("a"), F.col("node").alias("b")), signed, threshold), texts, signed, threshold)
    roots = components(links)
    placed = stored(under.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    met = placed.select("bucket", "root").distinct().withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1").drop("n")
    apart = met.withColumnRenamed("root", "x").join(met.withColumnRenamed("root", "y"), "bucket").where("x < y")
    across = (
        apart.join(placed.select("bucket", F.col("root").alias("x"), F.col("node").alias("a")), ["bucket", "x"])
        .join(placed.select("bucket", F.col("root").alias("y"), F.col("node").alias("b")), ["bucket", "y"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    more = _joining(_alike(across, signed, threshold), roots, texts, signed, threshold)
    return roots if more.isEmpty() else components(links.unionByName(more))


def _products(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by matrix products over the shingles that both sides have."""
    x, y = np.concatenate(rows), np.concatenate(cols)
    both = np.intersect1d(x, y)
    total = np.zeros((len(rows), len(cols)))
    places = []
    for flat, sets in ((x, rows), (y, cols)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        places.append((at[order], owner[order]))
    for lo in range(0, len(both), LINK_SHINGLES):
        hi = min(lo + LINK_SHINGLES, len(both))
        held = []
        for (at, owner), sets in zip(places, (rows, cols)):
            i, j = np.searchsorted(at, (lo, hi))
            m = np.zeros((len(sets), hi - lo), dtype=np.float32)
            m[owner[i:j], at[i:j] - lo] = 1  # sums up to LINK_SHINGLES are exact
            held.append(m)
        total += held[0] @ held[1].T
    return total


def _groups(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """The nodes ``(node, block, mark, set)`` of each ``(root, i, j)``, whose rows follow each other; once, where rows are repeated."""
    group, held = None, {}
    for batch in batches:
        for r, i, j, node, block, own_mark, own in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "block", mark, "own"))):
            if (r, i, j) != group:
                if held:
                    yield group, list(held.values())
                group, held = (r, i, j), {}
            held[node] = (node, block, own_mark, np.frombuffer(own, np.uint64))
    if held:
        yield group, list(held.values())


def _compared(group: tuple, held: list[tuple], threshold: float) -> Iterator[tuple[list[tuple], list[tuple], np.ndarray, bool]]:
    """Parts of the two blocks of a group, which of their nodes are linked, and whether both parts are the same."""
    _, i, j = group
    first, second = ([h for h in held if h[1] == k] for k in (i, j))
    for p in range(0, len(first), LINK_ROWS):
        rows = first[p : p + LINK_ROWS]
        for q in range(p if i == j else 0, len(second), LINK_ROWS):
            cols = second[q : q + LINK_ROWS]
            shared = _products([h[3] for h in rows], [h[3] for h in cols])
            sizes = np.array([len(h[3]) for h in rows], dtype=float)[:, None] + np.array([len(h[3]) for h in cols], dtype=float)[None, :]
            near = shared / (sizes - shared) >= threshold
            if same := i == j and p == q:
                np.fill_diagonal(near, False)
            yield rows, cols, near, same


def _counted(threshold: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the nodes of two blocks of a class with each other."""
        for group, held in _groups(batches, "copies"):
            sums = {h[0]: 0 for h in held}
            for rows, cols, near, same in _compared(group, held, threshold):
                for own, others, m in ((rows, cols, near), (cols, rows, near.T))[: 1 if same else 2]:
                    for h, n in zip(own, m @ np.array([x[2] for x in others], dtype=np.int64)):
                        sums[h[0]] += int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["node", "links"])

    return count


def _joining(pairs: DataFrame, roots: DataFrame, texts: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: a link between each two classes that one joins, among ``pairs``. Each set is sent once to a pair of blocks with a candidate."""
    nodes = components(pairs)
    sizes = nodes.join(signed.select("node", "size").distinct(), "node")
    blocks = sizes.groupBy("root").agg(F.ceil(F.sum(8 * F.col("size")) / LINK_BYTES).cast("int").alias("blocks"))
    place = stored(nodes.join(blocks, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    wanted = place.join(roots.select("node", F.col("root").alias("own_class")), "node", "left").withColumn("class", F.coalesce("own_class", "node")).drop("own_class")
    sets = _with_sets(texts, signed, wanted, "root long, node long, block int, class long")
    x, y = (place.select("root", F.col("node").alias(n), F.col("block").alias(c)) for n, c in (("a", "x"), ("b", "y")))
    asked = pairs.join(x, "a").join(y.drop("root"), "b").select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()
    sides = asked.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    placed = sets.join(sides, ["root", "block"]).select("root", "i", "j", "node", "block", "class", "own")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, held in _groups(batches, "class"):
            links: dict[tuple, tuple] = {}
            for rows, cols, near, _ in _compared(group, held, threshold):
                p, q = (np.array([h[2] for h in side]) for side in (rows, cols))
                for i, j in zip(*np.nonzero(near & (p[:, None] != q[None, :]))):
                    links.setdefault((min(p[i], q[j]), max(p[i], q[j])), (min(rows[i][0], cols[j][0]), max(rows[i][0], cols[j][0])))
            a, b = zip(*links.values()) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return stored(placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(join, "a long, b long"))


def linked(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``(doc_id, class_id, links)``: a row a document, the least id of its class, and how many documents it is linked to.

    Documents are linked where their Jaccard similarity is at least ``threshold``, and a class is what links
    connect. Similarities are exact. The search for classes finds a pair with a chance of at least
    ``target``, less the 3 in 100,000 of ``SLACK``, and identical shingle sets always; within a class every two
    documents are compared, so no link there is lost. Rows that repeat an id and a shingle set are one
    document; an id with several sets has a row for each, and those are documents like others. Documents
    of one or two words have one shingle, their whole text. Ids without a word are a class of their own
    without links; rows with a null id are left out; texts of any length are read whole; an empty table gives
    no rows. Ids are whole numbers. Only ``doc_id`` and ``text`` are read.
    """
    texts, signed = _texts_signed(docs)
    roots = stored(classes(texts, signed, threshold, target))
    members = signed.select("doc_id", "node").distinct()
    copies = members.groupBy("node").agg(F.count("*").alias("copies"))
    sizes = roots.join(signed.select("node", "size").distinct(), "node")
    blocks = sizes.groupBy("root").agg(F.ceil(F.sum(8 * F.col("size")) / LINK_BYTES).cast("int").alias("blocks"))
    wanted = roots.join(blocks, "root").join(copies, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = _with_sets(texts, signed, wanted, "root long, node long, block int, blocks int, copies long")
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("ij")
    placed = sets.select("root", "node", "block", "copies", "own", others).select("root", "ij.i", "ij.j", "node", "block", "copies", "own")
    counted = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_counted(threshold), "node long, links long")
    links = stored(counted.groupBy("node").agg(F.sum("links").alias("links")))
    whole = members.join(roots, "node", "left").join(links, "node", "left").join(copies, "node")
    whole = stored(whole.select("doc_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    least = whole.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    wordless = ids.join(whole, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return whole.join(least, "root").select("doc_id", "class_id", "links").unionByName(wordless)


def redundant(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``(key)`` of all rows but one of each group that links connect, the one with the least id.

    A row's key is the hash of its id and text, so that an id with several texts takes part with each.
    """
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(row_key().alias("key"), F.col("doc_id").alias("id"), "text")
    texts, signed = _texts_signed(keyed.select(F.col("key").alias("doc_id"), "text"))
    members, roots = signed.select("doc_id", "node").distinct(), classes(texts, signed, threshold, target)
    ids = keyed.select("key", "id").distinct()
    grouped = members.withColumnRenamed("doc_id", "key").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")).join(ids, "key")
    least = grouped.groupBy("root").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return grouped.join(least, "root").where("key <> least.key").select("key").distinct()


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the least id.

    Rows with the same id and text become one. An id that is repeated with different texts takes part with
    each of them, and loses only those of which another copy stays. Rows with a null id are compared by
    their whole text only; null and wordless texts are kept. All columns stay, whatever their names.
    """
    gone = stored(redundant(docs, threshold, target))
    key = fresh_name(docs.columns, "_key")
    gone = gone.withColumnRenamed("key", gone_ := fresh_name([*docs.columns, key], "_gone"))
    rank = fresh_name(docs.columns, "_rank")
    rest = docs.withColumn(key, row_key()).join(gone, F.col(key) == F.col(gone_), "left_anti")
    # The join leaves the rows hashed by key, which is all that this window needs.
    return rest.withColumn(rank, F.row_number().over(Window.partitionBy(key, "doc_id", "text").orderBy(F.lit(0)))).where(F.col(rank) == 1).drop(rank, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + least({WORDS}, len(w)) - 1], ' ')
         FOR i IN range(1, len(w) - least({WORDS}, len(w)) + 2)])) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE k::DOUBLE / (x.n + y.n - k) >= {THRESHOLD}
), l AS (SELECT doc_a AS x, doc_b AS y FROM near UNION ALL SELECT doc_b, doc_a FROM near),
r AS (SELECT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(k.links, 0) AS links FROM c LEFT JOIN k ON k.x = c.doc_id
"""
