"""Graph, concept and card tables on storage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schema
from lattica.runtime import ship


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by id without their bodies, edges by source, relation and target; a commit is all or nothing."""
    nodes.drop("body_text").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sortWithinPartitions("source", "relation", "target").write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document a file: ``{meta, nodes, edges}``; spans become line numbers."""
    kept = re.sub(r"start_line int, end_line int, ", "span string, ", schema.NODES)
    doc = spark.read.schema(f"nodes array<struct<{_struct(kept)}>>, edges array<struct<{_struct(schema.EDGES)}>>").json(path, multiLine=True)
    n = doc.select(F.inline("nodes"))
    bounds = [F.regexp_extract("span", r"^L(\d+)-L(\d+)$", i) for i in (1, 2)]
    n = n.select("*", *[F.nullif(b, F.lit("")).cast("int").alias(c) for b, c in zip(bounds, ("start_line", "end_line"))]).drop("span")
    return n, doc.select(F.inline("edges"))


def _struct(columns: str) -> str:
    """``a int, b struct<…>`` as the inside of a struct type."""
    out, depth = [], 0
    for part in re.split(r"(,|<|>)", columns):
        depth += (part == "<") - (part == ">")
        out.append(part if depth or part in ",<>" else re.sub(r"^(\s*\w+) ", r"\1: ", part))
    return "".join(out)


_FRONT = re.compile(r"\A---\n(.*?)\n---\n?(.*)\Z", re.S)
BLOCK_START, BLOCK_END = "<!-- generated:start -->", "<!-- generated:end -->"


def parse_concept(text: str) -> dict | None:
    """Front matter of ``key: value`` lines, values as JSON where they parse; the body splits at the generated block."""
    m = _FRONT.match(text or "")
    if not m:
        return None
    fields: dict = {}
    for line in m.group(1).split("\n"):
        key, colon, value = line.partition(":")
        if colon and re.fullmatch(r"\w+", key):
            try:
                fields[key] = json.loads(value)
            except ValueError:
                fields[key] = value.strip()
    _, _, rest = m.group(2).partition(BLOCK_START)
    made, _, human = rest.partition(BLOCK_END)
    return {**fields, "summary": made.strip(), "human": human.strip("\n") if rest else m.group(2).strip("\n")}


def render_concept(row: dict) -> str:
    keys = ("name", "slug", "type", "sources", "sources_digest", "links")
    head = "\n".join(f"{k}: {json.dumps(row.get(k), ensure_ascii=False)}" for k in keys)
    return f"---\n{head}\n---\n{BLOCK_START}\n{row.get('summary') or ''}\n{BLOCK_END}\n{row.get('human') or ''}\n"


def read_concepts(files: DataFrame) -> DataFrame:
    """Concept rows of markdown files ``(path, text)``; files without front matter are left out."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(c) if (c := parse_concept(t)) else None)

    return files.select(F.from_json(parse("text"), schema.CONCEPTS).alias("c")).where("c IS NOT NULL").select("c.*")


def merged_concepts(new: DataFrame, old: DataFrame) -> DataFrame:
    """New concepts with the text that people wrote under the old ones of the same slug."""
    kept = old.select("slug", F.col("human").alias("_human"))
    return new.join(kept, "slug", "left").withColumn("human", F.coalesce("_human", "human")).drop("_human").select(*new.columns)


def cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, card)``: a markdown list of each file's symbols in order, with their callers counted."""
    from lattica.operators.graph import in_degree

    counted = nodes.join(in_degree(edges), "id", "left").where("kind <> 'file'")
    line = F.concat(F.lit("- `"), F.coalesce("signature", "name"), F.lit("` "), "kind", F.lit(" L"), "start_line", F.lit("-L"), "end_line", F.lit(", in "), F.coalesce("in_degree", F.lit(0)))
    members = F.array_sort(F.collect_list(F.struct("start_line", "name", line.alias("line"))))
    return counted.groupBy("path").agg(members.alias("m")).select("path", F.concat(F.lit("# "), "path", F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("\n")).alias("card"))


def write_cards(rows: DataFrame, folder: str) -> DataFrame:
    """Write each card beside its path under ``folder``, a folder that all executors share; returns what was written."""
    ship(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, card in zip(paths, batch.column("card").to_pylist()):
                target = f"{folder}/{path}.md"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "w", encoding="utf-8") as out:
                    out.write(card)
                os.replace(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return rows.select("path", "card").mapInArrow(write, "path string")


def stale(written: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths written earlier that no card is wanted for any more."""
    return written.select("path").join(wanted.select("path"), "path", "left_anti")
