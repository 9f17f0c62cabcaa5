"""Operator 7: jump consistent hashing of stable keys onto shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.runtime import ship

SHARDS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; going from n to n+1 shards moves a key only to shard n."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(state), dtype=np.int64)
    live, at = np.arange(len(state)), np.zeros(len(state), dtype=np.int64)
    while len(live):
        out[live] = at
        step = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = step
        at = np.floor((at + 1) * (2147483648.0 / ((step >> np.uint64(33)).astype(np.float64) + 1.0)))
        going = at < shards
        live, at = live[going], at[going].astype(np.int64)
    return out


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Rows ``(key, shard)``, one for each row of ``df``.

    Whole numbers are keys as they are; keys of any other type, texts of any length too, are hashed to 64
    bits by ``xxhash64`` first. Narrow: no shuffle, one pass over one column. A null key has a null
    shard; repeated keys share their shard; an empty table gives no rows; other columns, whatever their
    names, aren't read.
    """

    ship(df.sparkSession)

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            known = ids.notna().to_numpy()
            out = pd.Series(np.full(len(ids), None), dtype="Int32")
            out[known] = jump_hash(ids[known].astype("int64").to_numpy(), shards).astype("int32")
            yield out

    number = F.col(key).cast("long") if isinstance(df.schema[key].dataType, T.IntegralType) else F.xxhash64(key)
    shard = F.when(F.col(key).isNotNull(), shard_of(F.coalesce(number, F.lit(0))))
    return df.select(F.col(key), shard.alias("shard" if key != "shard" else "shard_"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE jump(doc_id, state, b, j) AS (
  SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END),
         -1::BIGINT, 0::BIGINT
  FROM documents
  UNION ALL
  SELECT doc_id, nxt, j,
         floor((j + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592::HUGEINT)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM (SELECT doc_id, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nxt
        FROM jump WHERE j < {SHARDS})
)
SELECT doc_id, max(b)::INTEGER AS shard FROM jump GROUP BY doc_id
"""
