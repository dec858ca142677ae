"""Helpers shared by the corpus operators: shared scratch tables, bounded
membership bitmaps, distributed row numbers and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ensure_checkpoint_dir

#: Records of one Arrow batch; with the byte limit below it bounds a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches: texts may be long, Python workers are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables of one job in the shared folder named by ``spark.checkpoint.dir``.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage and
    survives lost executors; ``drop`` deletes a table that no later step reads.
    ``keep_by`` writes a table that lies bucketed by a key, so joins by that key
    shuffle the other side alone.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{job}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        table = self.tables[name] = re.sub(r"\W", "_", f"{self.root.rsplit('/', 1)[1]}_{name}")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(parts, key).option("path", self.path(name)).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:  # the catalog's entry; the files lie in the shared folder
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- membership

#: log2 of the bits of a membership bitmap: 2**27 bits are 16 MB, whatever the input.
BITMAP_BITS = 27


def hash_bitmap(df: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size (2**bits bits) of the 64-bit hashes in ``key``.

    A set bit may be a false positive, an unset bit never is a false negative,
    so it may only be used to skip work whose result is then decided exactly.
    """
    at = F.pmod(F.col(key), F.lit(1 << bits)) + 1  # the functions count values from 1 in buckets from 1
    rows = (df.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
              .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())  # at most 2**bits / 32768 rows
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for b, m in rows:
        start = (b - 1) * 4096
        out[start:start + 4096] = np.frombuffer(bytes(m), np.uint8)[:len(out) - start]
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 ``keys`` may be in the bitmap."""
    at = keys.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ----------------------------------------------------------- rows with texts

def row_keys(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a row's id and text in joins."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(1), *cols).alias("_k2")]


def deal_out(docs: DataFrame, cols: list[Column], counts: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``counts`` (_k1, _k2, copies, rows) says.

    ``copies`` is for all rows of a key together; rows equal in ``cols`` share
    it evenly.  The texts are shuffled once, by the keys.
    """
    alike = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    keyed = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_keys(*cols))
                 .withColumn("_nth", F.row_number().over(alike)))
    each = F.floor(F.col("copies") / F.col("rows")) + (F.col("_nth") <= F.col("copies") % F.col("rows")).cast("long")
    return (keyed.join(counts, ["_k1", "_k2"]).withColumn("_c", each).filter("_c > 0")
                 .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c")))).select("_row.*"))


# --------------------------------------------------------------- row numbers

def global_index(df: DataFrame, order: Iterable[Column], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``_idx``: 0, 1, 2, ... in the given order over the whole table.

    The rows are range-partitioned and sorted, written once (range bounds come
    from a sample, so they must not be drawn again), and numbered by the row
    counts of the partitions before them.  No task sees more than its range.
    """
    order = list(order)
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_at", F.monotonically_increasing_id()))
    saved = scratch.keep(ranged.withColumn("_part", F.shiftright("_at", 33))
                               .withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), name)
    counts = saved.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (saved.join(F.broadcast(offsets), "_part")
                 .withColumn("_idx", F.col("_off") + F.col("_at")).drop("_part", "_at", "_off"))


# ---------------------------------------------------------------- components

def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of the links (a, b): one row (id, root), root the smallest id.

    Alternates large-star and small-star steps; each round is written to the
    shared folder; only the links' number and a checksum come to the driver.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    links = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                              .filter("u <> v").distinct(), f"{name}-0")
    last, step, before = f"{name}-0", 0, state(links)
    while before[0]:
        step += 1
        # large star: every larger neighbour of u links to u's smallest neighbour (or u)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, link to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
                     F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                     F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        links = scratch.keep(small, f"{name}-{step}")
        scratch.drop(last)
        last, now = f"{name}-{step}", state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")) \
                .union(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
