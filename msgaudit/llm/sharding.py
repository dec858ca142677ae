"""Sharding by a Feistel permutation with cycle walking.

Rows are numbered 0 .. n-1 in id order (ties by text checksum and size).  A
keyed Feistel network permutes the smallest even-bit domain that holds n;
values outside 0 .. n-1 are permuted again until they fall inside (cycle
walking), which gives a permutation of the row numbers themselves.  Row number
i goes to position p = P(i), shard p mod s, slot p div s: the shuffle can be
repeated, and shard and slot of any row number computed, from (seed, n, s)
alone.  Shards differ by at most one row and slots have no gaps.

Null ids are numbered first, null texts count as empty, rows equal in every
respect get different numbers in either order.  An empty table gives an empty
result.  Groups of equal texts are not kept together: the law is ``rows``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_index

SHARDS = 16
SEED = 20240517
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Positions of the row numbers under the keyed permutation of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, ROUNDS)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, int(k)) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(n)]  # cycle walking; the domain is under 4 n, so few steps
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, row, position, shard, slot."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = global_index(slim, [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], scratch, "rows")
    n = docs.sparkSession.read.parquet(scratch.path("rows")).count()

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return (rows.withColumnRenamed("_idx", "row").withColumn("position", position("row"))
                .withColumn("shard", (F.col("position") % shards).cast("int"))
                .withColumn("slot", F.floor(F.col("position") / shards).cast("long")))
