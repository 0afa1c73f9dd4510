"""Sharding by jump consistent hashing (Lamping & Veach 2014).

A stable 64-bit key and the number of shards give the shard; there is no ring table. When
one shard is appended, a row either keeps its shard or moves into the new one, and an even
share of rows moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_block, materialise, running_offsets, table


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to ``shards`` - 1 of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = np.asarray(keys).astype(np.uint64)
    bucket = np.zeros(len(state), np.int64)
    active, ahead = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(active):
        bucket[active] = ahead
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((ahead + 1) * (2.0**31 / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        active, ahead = active[ahead < shards], ahead[ahead < shards]
    return bucket.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key column."""

    @F.pandas_udf(T.IntegerType())
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return shard(key)


def stable_key(docs: DataFrame, id_col: str) -> Column:
    """A hash of the id: the same for an id in whole-number columns of any width."""
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.xxhash64(F.col(id_col).cast("long") if whole else F.col(id_col))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``shard``: a function of the id and ``shards`` alone.

    A null id is a key like any other; repeated ids and equal rows share a shard; an
    existing ``shard`` column is replaced. An empty table gives an empty table.
    """
    return docs.withColumn("shard", jump_shard(stable_key(docs, id_col), shards))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", salts: int = 8) -> None:
    """Write one folder per shard; each shard is dealt to ``salts`` tasks, so none holds a whole shard.

    All rows and columns are written, null and repeated ids included; an empty table writes
    a folder without rows.
    """
    out = shard_documents(docs, shards, id_col)
    out.repartition(shards * salts, "shard", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).write.partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: size, text digest, shard, gapless slot in its shard, and its shard with one more.

    Null text counts as empty, texts of any length are digested whole. Null and repeated ids
    and equal rows take a slot each; further columns are ignored; an empty table gives no
    rows. Slots follow a hash of the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = stable_key(rows, "doc_id")
    rows = materialise(rows.select("*", jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"), F.lit(1).cast("long").alias("_one")))
    out = running_offsets(rows, ["shard"], hash_block("_row"), ["_row"], "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, of 16, of every document under the law ``key``; cases as in ``shard_manifest``."""
    return shard_manifest(table(spark, sf_dir, "documents"), 16)
