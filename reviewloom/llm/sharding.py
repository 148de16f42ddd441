"""Sharding by jump consistent hashing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the generator that the jump hash paper (Lamping and Veach, 2014) names.
JUMP_MULTIPLIER = 2862933555777941757
#: Rows that one task numbers within a shard.
BLOCK_ROWS = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each unsigned 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[jump[live] < shards]
    return shard.astype(np.int32)


def jump_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row a shard, and a slot within it, by its id and the shard count alone.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32, law (``key``), shard, slot, grown_shard (the shard
    with one shard more: the same, or the new one) and key (what is hashed: an integer id itself, else its hash).
    A row without an id is placed by a hash of its text, so many
    of them are no one shard; a null text has no bytes and the checksum of the empty text. Repeated rows get a slot
    each. Slots follow the key within a shard and have no gaps. Only ids and checksums are shuffled, never texts: keys
    are cut at quantiles into blocks of about BLOCK_ROWS rows of a shard, a prefix sum over the block counts gives
    each block its first slot, and rows are numbered inside their block.
    """
    whole = dict(docs.select(id_col).dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    given = F.col(id_col)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.when(given.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(given.cast("long") if whole else F.xxhash64(given))
    rows = docs.select(given.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    n = rows.count()
    blocks = max(1, math.ceil(n / (shards * BLOCK_ROWS)))
    cuts = np.array([], np.int64)
    if blocks > 1:
        at = [i / blocks for i in range(1, blocks)]
        cuts = np.array(sorted(set(rows.agg(F.percentile_approx("key", at, 10_000).alias("c")).first().c)), np.int64)

    @F.pandas_udf("shard int, grown_shard int, block int")
    def place(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64)
        bits = k.view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(bits, shards), "grown_shard": jump_hash(bits, shards + 1), "block": np.searchsorted(cuts, k).astype(np.int32)})

    placed = rows.withColumn("at", place("key")).select("doc_id", "size", "text_crc32", "key", "at.shard", "at.grown_shard", "at.block")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("rows_here"))
    first = counts.select("shard", "block", (F.sum("rows_here").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows_here")).alias("first_slot"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "doc_id", "text_crc32", "size")
    return (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(first, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("inside")).cast("long").alias("slot"), "grown_shard", "key")
    )
