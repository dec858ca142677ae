"""Exact dedup by progressive refinement.

1. Lengths are counted (bytes of the normalised text).  A length that occurs
   once proves its row unique.
2. Rows of shared lengths are keyed by (length, hash of the first bytes) and
   counted.  A key that occurs once proves its row unique.
3. Only rows of shared keys get the digest of their full text, and are grouped
   by it.

Shared lengths and keys reach the scans as bitmaps of fixed size: a false
positive only costs a hash, since the full digest decides.  Texts are never
shuffled, groups are pre-aggregated before their shuffle, and only small rows
(id, keys, digest) are written to the shared folder.

Texts are equal when identical after lower-casing A-Z.  Null texts count as
empty, so they equal each other and the empty text.  Of a group the row with
the largest id stays (null ids are smallest); of repeated rows with that id
exactly one is marked.  An empty table gives an empty result, and extra columns
of any name are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, deal_out, hash_bitmap, in_bitmap, row_keys

#: Bytes of a text that the second step hashes.
PREFIX_BYTES = 64
#: log2 of the bits of the survivors' bitmaps (2 MB each); fuller ones only let more rows be hashed.
BITS = 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def _prefix_key(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw[:PREFIX_BYTES], seed=len(raw) & 0xFFFFFFFF) - (1 << 63)


def _prefix_keys(lengths):
    """Second step: the (length, prefix) key of rows whose length is shared."""
    def run(batches):
        for b in batches:
            raws = [normalise(t) for t in b.column(0).to_pylist()]
            shared = in_bitmap(lengths.value, np.array([len(r) for r in raws], np.int64))
            keys = [_prefix_key(r) for r, s in zip(raws, shared) if s]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64())})
    return run


def _digests(prefixes, every_digest: bool):
    """Third step: one slim row per document, the digest where the key is shared."""
    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column("text").to_pylist()
            raws = [normalise(t) for t in texts]
            keys = np.array([_prefix_key(r) for r in raws], np.int64)
            shared = in_bitmap(prefixes.value, keys)
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "_k1": b.column("_k1"), "_k2": b.column("_k2"), "row": pa.array(range(row, row + len(raws)), pa.int64()),
                "length": pa.array([len(r) for r in raws], pa.int64()),
                "shared": pa.array(shared),
                "digest": pa.array([hashlib.sha256(r).hexdigest() if every_digest or s else None
                                    for r, s in zip(raws, shared)], pa.string())})
            row += len(raws)
    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                every_digest: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (and the row's keys).

    ``digest`` is the SHA-256 of the normalised text, null for rows that an
    earlier step proved unique unless ``every_digest`` asks for all.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "exact-dedup")
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(doc_id.alias("id"), text.alias("text"))

    # lower-casing A-Z keeps the number of bytes, so the length needs no copy of the text
    lengths = (rows.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("key"))
                   .groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared_lengths = spark.sparkContext.broadcast(hash_bitmap(lengths, "key", BITS))
    prefixes = (rows.select("text").mapInArrow(_prefix_keys(shared_lengths), "key long")
                    .groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared_prefixes = spark.sparkContext.broadcast(hash_bitmap(prefixes, "key", BITS))
    keyed = docs.select(doc_id.alias("id"), text.alias("text"), *row_keys(doc_id, text))
    slim = scratch.keep(keyed.mapInArrow(_digests(shared_prefixes, every_digest),
                                         "id long, _k1 long, _k2 long, row long, length long, shared boolean, digest string"),
                        "rows")

    survivors = slim.filter("shared")
    # written, so that the join below is one of two shuffles and a hot group can be split
    groups = scratch.keep(survivors.groupBy("length", "digest")
                          .agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size")), "groups")
    grouped = (survivors.join(groups, ["length", "digest"])
                        .select("id", F.col("top.id").alias("keep_id"), "group_size",
                                (F.col("row") == F.col("top.row")).alias("kept"), "digest", "_k1", "_k2"))
    alone = slim.filter("NOT shared").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                             F.lit(True).alias("kept"), "digest", "_k1", "_k2")
    return grouped.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose row stays, with all their columns."""
    counts = (exact_dedup(docs, id_col, text_col).groupBy("_k1", "_k2")
              .agg(F.count_if("kept").alias("copies"), F.count("*").alias("rows")).filter("copies > 0"))
    return deal_out(docs, [F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")], counts)
