"""Operator 3: chat formatting as prefix trees of conversations.

Conversations that begin with the same turns share one path of a tree. Each distinct turn in its
context is a node, whose tokens are emitted once, depth first; a token's position id counts the tokens
before it on its own path, and it may attend to the intervals of its ancestors.

A conversation is one row, a path of 20 bytes a turn. Paths in order are a depth-first walk: what a path
shares with the one before it is there already, and the rest are new nodes. Paths are sorted by range,
and a part of the order is walked with nothing but the current path in memory, so no task ever holds a
tree, however many conversations open with the same turn, and the work grows with the number of turns.
What is open where a part begins is told by the driver from one row a part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from lattica.llm.packing import TOKENIZER, encoding, pieces_of
from lattica.runtime import ship, stored

#: Bytes of a turn in a path: 16 of its digest and its number of tokens.
STEP = 20
#: Ids after the tokenizer's own 50,256: the end of a turn, then one marker for each role.
END_OF_TURN = 50256
ROLES = {"system": 50257, "user": 50258, "assistant": 50259, "tool": 50260}
OTHER_ROLE = 50261


def turn_tokens(role: str | None, text: str | None, tokenizer: str = TOKENIZER) -> list[int]:
    """Role marker, text, end. Another role's name follows its marker, ended like a turn; null is an empty name."""
    encode = encoding(tokenizer).encode_ordinary
    out = [ROLES[role]] if role in ROLES else [OTHER_ROLE, *encode(role or ""), END_OF_TURN]
    for part in pieces_of(text or ""):
        out += encode(part)
    return [*out, END_OF_TURN]


def _rows(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """``(conv_id, turn, code, tokens)`` of distinct turns; equal codes mean equal roles and texts."""

    @F.pandas_udf("array<int>")
    def tokens_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for roles, texts in batches:
            yield pd.Series([turn_tokens(r, t, tokenizer) for r, t in zip(roles, texts)], dtype=object)

    own = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("role").isNull(), "n").otherwise(F.concat(F.lit("r"), F.sha2("role", 256)))
    code = F.unhex(F.substring(F.sha2(F.concat(role, F.sha2(F.coalesce("text", F.lit("")), 256)), 256), 1, 32))
    return own.select("conv_id", "turn", code.alias("code"), tokens_of("role", "text").alias("tokens"))


def _key(conv_id: Column, turn: Column, code: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("|", conv_id.cast("string"), F.coalesce(turn.cast("string"), F.lit("none")), F.hex(code)), 256))


def _shared(a: bytes, b: bytes) -> int:
    """How many whole turns two paths have in common at their beginnings."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + STEP] == b[k : k + STEP]:
        k += STEP
    return k // STEP


def _sizes(path: bytes) -> list[int]:
    return [struct.unpack_from(">I", path, k + STEP - 4)[0] for k in range(0, len(path), STEP)]


SUMMARY = "part int, first binary, last binary, nodes long, tokens long, passed array<long>, open_node array<long>, open_at array<long>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part, counted as if no node were open before it.

    ``passed`` counts, for each turn of the first path, the conversations of this part that pass it;
    ``open_node`` and ``open_at`` say where the turns of the last path stand among the part's nodes and tokens.
    """
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    part = first = last = None
    nodes = tokens = seen = still = 0
    passed: list[int] = []
    spot: list[tuple[int, int]] = []

    def row() -> pa.RecordBatch:
        values = (part, first, last, nodes, tokens, [seen if k < still else p for k, p in enumerate(passed)], [n for n, _ in spot], [t for _, t in spot])
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=["part", "first", "last", "nodes", "tokens", "passed", "open_node", "open_at"])

    for batch in batches:
        for p, path, n in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n"))):
            if p != part:
                if part is not None:
                    yield row()
                part, first, last, nodes, tokens, seen, spot = p, path, b"", 0, 0, 0, []
                still = len(path) // STEP
                passed = [0] * still
            common = _shared(path, last)
            for k in range(common, still):  # turns of the first path that end here
                passed[k] = seen
            if last:
                still = min(still, common)
            del spot[common:]
            for size in _sizes(path)[common:]:
                spot.append((nodes, tokens))
                nodes, tokens = nodes + 1, tokens + size
            last, seen = path, seen + n
    if part is not None:
        yield row()


def _openings(rows: list) -> dict[int, tuple[int, int, list[tuple[int, int, int]], dict[int, int]]]:
    """For each part: nodes and tokens before it, the open path ``(node, at, size)`` at its beginning, and for
    each depth that it leaves open the conversations of later parts that pass there."""
    out, nodes, tokens, last = {}, 0, 0, b""
    stack: list[tuple[int, int, int, int]] = []  # node, at, size, owner's part
    for r in sorted(rows, key=lambda r: r.part):
        first, end = bytes(r.first), bytes(r.last)
        common = _shared(first, last)
        held = stack[:common]
        sizes = _sizes(first)
        out[r.part] = (nodes, tokens, [x[:3] for x in held], {})
        for depth, x in enumerate(held):
            later = out[x[3]][3]
            later[depth] = later.get(depth, 0) + r.passed[depth]
        # The first `common` nodes of the part, counted as its own, are there already.
        skip = sum(sizes[:common])
        stack = [held[d] if n < common else (nodes + n - common, tokens + at - skip, size, r.part) for d, (n, at, size) in enumerate(zip(r.open_node, r.open_at, _sizes(end)))]
        nodes, tokens, last = nodes + r.nodes - common, tokens + r.tokens - skip, end
    return out


def _walker(openings, kind: pa.DataType):
    """From paths in order to nodes; a node is written when the walk leaves it and its conversations are counted."""
    interval = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    names = ["tree_id", "node", "parent", "depth", "conversations", "start", "position", "attends", "ends", "conv_id", "turn", "code"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(interval), pa.list_(kind), kind, None, pa.binary()]

    def reach(spans: tuple, start: int, size: int) -> tuple:
        """The intervals with one more behind them, merged where they touch."""
        if spans and spans[-1][1] == start:
            return (*spans[:-1], (spans[-1][0], start + size))
        return (*spans, (start, start + size))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, nodes, tokens = None, b"", 0, 0, 0
        later: dict[int, int] = {}
        # node, at, position behind it, intervals up to it, conversations before it, what to write (None if another part does)
        stack: list[tuple[int, int, int, tuple, int, list | None]] = []
        out: list[list] = []
        turn_kind = None

        def leave(depth: int, at_end: bool) -> None:
            while len(stack) > depth:
                *_, before, row = stack.pop()
                if row is not None:
                    row[4] = seen - before + (later.get(len(stack), 0) if at_end else 0)
                    out.append(row)

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k or turn_kind) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            turn_kind = batch.schema.field("turns").type.value_type
            for p, path, n, ids, conv, turns in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "n", "ids", "conv_id", "turns"))):
                if p != part:
                    leave(0, True)
                    part, seen, (nodes, tokens, held, later) = p, 0, openings.value[p]
                    position, spans = 0, ()
                    for node, at, size in held:
                        spans = reach(spans, at - held[0][1], size)
                        position += size
                        stack.append((node, at, position, spans, 0, None))
                    last = path[: STEP * len(held)]
                common = _shared(path, last)
                leave(common, False)
                sizes = _sizes(path)
                for d in range(common, len(sizes)):
                    up = stack[-1] if stack else None
                    root_node, root_at = stack[0][:2] if stack else (nodes, tokens)
                    start, above = tokens - root_at, up[3] if up else ()
                    row = [
                        root_node, nodes, up[0] if up else None, d + 1, 0, start, up[2] if up else 0, [{"from": a, "to": b} for a, b in above],
                        ids if d + 1 == len(sizes) else [], conv, turns[d], path[d * STEP : d * STEP + 16],
                    ]
                    stack.append((nodes, tokens, row[6] + sizes[d], reach(above, start, sizes[d]), seen, row))
                    nodes, tokens = nodes + 1, tokens + sizes[d]
                last, seen = path, seen + n
                if len(out) >= 2000:
                    yield batch_of(out)
                    out.clear()
        leave(0, True)
        if out:
            yield batch_of(out)

    return walk


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a node: ``(tree_id, node, parent, depth, conversations, ends, start, position, tokens, attends)``.

    Nodes number from 0 in depth-first order over all trees and ``tree_id`` is the number of the
    tree's first node. ``start`` is the node's first token in its tree, ``position`` its first position
    id (token i has ``position + i``), ``attends`` the ancestors' token intervals ``[from, to)``, merged
    where they touch, nearest last; a token also attends to its own node's tokens before it. ``ends``
    lists the conversations whose last turn this is, all repeats of one conversation in one row, and
    ``conversations`` counts those that pass.

    Turns without a conversation are left out; a null turn number comes last; ties are ordered by
    their digests, and repeated rows count once. A null text is an empty one. A conversation of very
    many turns is one row of 20 bytes a turn; texts of any length are tokenized in pieces. An empty
    table gives no rows; further columns aren't read.

    Only paths are sorted. The tokens, written once, move once, to the node whose first witness they are.
    The driver holds a row a part of the order, with the first and the last path in it.
    """
    ship(conversations.sparkSession)
    spark = conversations.sparkSession
    rows = stored(_rows(conversations, tokenizer))
    step = F.struct(F.col("turn").isNull().alias("last"), "turn", "code", F.size("tokens").alias("n"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(step)).alias("all"))
    each = lists.select(
        "conv_id",
        F.expr("unhex(array_join(transform(all, x -> concat(hex(x.code), lpad(hex(x.n), 8, '0'))), ''))").alias("path"),
        F.expr("transform(all, x -> x.turn)").alias("turns"),
    )
    merged = each.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("conv_id")).alias("ids"), F.min_by("turns", "conv_id").alias("turns"))
    paths = stored(merged.withColumn("conv_id", F.col("ids")[0]).repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    in_order = paths.repartition("part").sortWithinPartitions("part", "path")
    summaries = in_order.select("part", "path", "n").mapInArrow(_summaries, SUMMARY).collect()  # a row a part
    openings = spark.sparkContext.broadcast(_openings(summaries))  # nodes open between parts, a path's turns a part
    conv_type, turn_type = conversations.schema["conv_id"].dataType, conversations.schema["turn"].dataType
    nodes = T.StructType(
        [
            *(T.StructField(c, T.LongType()) for c in ("tree_id", "node", "parent")),
            T.StructField("depth", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("conversations", "start", "position")),
            T.StructField("attends", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
            T.StructField("ends", T.ArrayType(conv_type)),
            T.StructField("conv_id", conv_type),
            T.StructField("turn", turn_type),
            T.StructField("code", T.BinaryType()),
        ]
    )
    built = in_order.mapInArrow(_walker(openings, pa_type(conv_type)), nodes)
    # Repeated rows fall together under the same hash partitioning that the join needs.
    tokens = rows.select(_key(F.col("conv_id"), F.col("turn"), F.col("code")).alias("key"), "tokens").repartition("key").dropDuplicates(["key"])
    placed = built.withColumn("key", _key(F.col("conv_id"), F.col("turn"), F.col("code"))).drop("conv_id", "turn", "code")
    found = placed.join(tokens, "key")
    return found.select("tree_id", "node", "parent", "depth", "conversations", "ends", "start", "position", "tokens", "attends")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
