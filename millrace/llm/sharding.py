"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A document's key and the number of shards decide its shard; there is no ring table, and when one
shard is appended, rows move only into it.

Defined results: a null doc_id is a key like any other (the empty string); rows that share a doc_id
share its shard, in slots of their own; a null text has no bytes, size 1 and crc32 0; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import with_position

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump hash of unsigned 64-bit keys, all at once."""
    key = keys.astype(np.uint64, copy=True)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while len(live := np.flatnonzero(to < shards)):
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
    return at.astype(np.int32)


def stable_key(doc_id: Column) -> Column:
    """The first 64 bits of the MD5 of the id as text, as a signed long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return jump(key)


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slot counts 0, 1, ... in each shard by doc_id, crc and size.  Only these narrow rows are
    shuffled, once, by ranges that split repeated ids too.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(stable_key(F.col("doc_id")), shards).alias("shard"),
        shard_of(stable_key(F.col("doc_id")), shards + 1).alias("grown_shard"),
    )
    placed = with_position(rows, [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size")], "shard")
    counts = placed.groupBy("shard").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard
    firsts = counts.select("shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("position") - F.col("_first")).alias("slot"), "grown_shard"
    )
