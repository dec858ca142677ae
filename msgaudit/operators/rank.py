"""K1-K5: ordering, top-N and row numbering.

* Global top-N is ``orderBy(...).limit(n)``, which Spark plans as
  ``TakeOrderedAndProject``: every task keeps its own best n, the driver merges
  n x tasks rows.
* Per-group top-N is ``row_number() <= n`` over a window; Spark inserts a
  ``WindowGroupLimit`` before the shuffle, so a platform with a third of all
  rows still ships only n rows per map task.
* Full row numbering (listing every message) must not use a window without a
  partition or with a hot partition key: that funnels everything into one task.
  ``number_rows`` range-partitions on (group, order) keys, numbers rows inside
  each task and adds per-task offsets computed from a table with one row per
  (task, group).

The reference sorts with an unstable sort and many ties (every lexicon hit has
confidence 0.99); callers pass a unique tie-breaker, source order at best, so
that results are reproducible.  Null keys are groups and places like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def top_n(df: DataFrame, n: int, order: list, barrier: bool = False) -> DataFrame:
    """K1/K2: the n first rows in ``order`` (a top-n report; the limit is the feature).

    ``barrier`` puts the n rows in one partition before anything else runs on
    them.  Needed when the next step calls Python: otherwise Spark moves the
    Python evaluation between the sort and the limit and plans a full sort of
    the input instead of ``TakeOrderedAndProject``.
    """
    out = df.orderBy(*_cols(order)).limit(n)
    return out.repartition(1) if barrier else out


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list, n: int,
                    rank_col: str = "rank") -> DataFrame:
    """K3 (+K4 numbering inside the group)."""
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).filter(F.col(rank_col) <= n)


LOW_BITS = (1 << 33) - 1


def _join_spans(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the offsets of their span; null keys are a group like any other.

    Spark picks the join by the measured size of the (small) span table.
    """
    renamed = spans.select(*[F.col(k).alias(f"_span_{k}") for k in keys], *[c for c in spans.columns if c not in keys])
    same = None
    for k in keys:
        eq = rows[k].eqNullSafe(renamed[f"_span_{k}"])
        same = eq if same is None else same & eq
    return rows.join(renamed, same, "inner").drop(*[f"_span_{k}" for k in keys])


def number_rows(df: DataFrame, group_cols: list[str], order: list, rank_col: str = "rank",
                num_partitions: int | None = None, checkpoint: bool = True,
                bucket_key: str | None = None, bucket_desc: bool = False) -> DataFrame:
    """K4: 1..n per group in ``order`` without a single-task window.

    When ``order`` leads with a numeric column, pass it as ``bucket_key``
    (``bucket_desc`` for descending): ``number_rows_bucketed`` is used, which
    is deterministic and materialises nothing.  Otherwise the
    range-partition + checkpoint method is used.
    """
    from pyspark.sql import types as T

    if bucket_key is not None and isinstance(df.schema[bucket_key].dataType, T.NumericType):
        return number_rows_bucketed(df, group_cols, order, (bucket_key, bucket_desc), rank_col, num_partitions)
    return number_rows_ranged(df, group_cols, order, rank_col, num_partitions, checkpoint)


def number_rows_bucketed(df: DataFrame, group_cols: list[str], order: list, lead, rank_col: str = "rank",
                         num_buckets: int | None = None, rel_err: float = 0.001) -> DataFrame:
    """K4 by quantile buckets of the leading order key.

    1. Approximate quantiles of the key (one pass over that column; at most
       ``num_buckets`` numbers reach the driver) cut it into buckets, so every
       group - also one holding a third of all rows - is split over many tasks.
    2. Rows are numbered inside each (group, bucket) window.
    3. Offsets come from the (group, bucket) counts: a small table, summed
       over earlier buckets.
    Bucket membership is an expression of the key, so both passes see the same
    rows; nothing is checkpointed.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    name, desc = lead
    n = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n for i in range(1, n)]
    bounds = sorted(set(df.approxQuantile(name, probs, rel_err))) if n > 1 else []
    splits = [float("-inf"), *bounds, float("inf")]
    with_key = df.withColumn("_key", F.col(name).cast("double"))
    if len(splits) > 2:
        bucketed = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(with_key)
    else:
        bucketed = with_key.withColumn("_b", F.lit(0.0))
    # rows without a key come first in ascending and last in descending order, NaN counts as the largest key
    last = len(splits) - 2
    place = (F.when(F.col("_key").isNull(), F.lit(-1.0)).when(F.isnan("_key"), F.lit(last + 1.0)).otherwise(F.col("_b")))
    bucketed = bucketed.withColumn("_b", (F.lit(float(last)) - place) if desc else place).drop("_key")
    counts = bucketed.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))).drop("_cnt")
    w = Window.partitionBy(*group_cols, "_b").orderBy(*_cols(order))
    local = bucketed.withColumn("_rn", F.row_number().over(w))
    out = _join_spans(local, offsets, [*group_cols, "_b"]).withColumn(
        rank_col, (F.col("_rn") + F.col("_offset")).cast("long"))
    return out.drop("_b", "_rn", "_offset")


#: Rows of a file that are numbered together in source order: 2 ** SPAN_BITS.
SPAN_BITS = 16


def with_position(df: DataFrame) -> DataFrame:
    """A file scan with its source order: ``path`` and ``row_id`` (the row's place in its file)."""
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_id"))


def number_in_source_order(df: DataFrame, group_cols: list[str], files: list[str], row_col: str = "row_id",
                           rank_col: str = "rank") -> DataFrame:
    """K4: 1..n per group in the order of ``files`` (path, table, ...) and of the row's place in them.

    A span is a run of at most 2 ** SPAN_BITS places of one file.  Rows are
    numbered inside their (group, span), so no window holds more however large
    a group is; the spans' offsets are sums over the earlier spans' counts, one
    row to a group and span.
    """
    spans = df.withColumn("_span", F.shiftright(F.col(row_col).cast("long"), SPAN_BITS))
    keys = [*group_cols, *files, "_span"]
    counts = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    earlier = Window.partitionBy(*group_cols).orderBy(*files, "_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0))).drop("_cnt")
    local = spans.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(row_col)))
    return (_join_spans(local, offsets, keys).withColumn(rank_col, (F.col("_rn") + F.col("_offset")).cast("long"))
            .drop("_span", "_rn", "_offset"))


def number_rows_ranged(df: DataFrame, group_cols: list[str], order: list, rank_col: str = "rank",
                       num_partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """K4: 1..n per group in ``order`` without a single-task window.

    ``order`` must be a total order (unique tie-breaker last).  The sorted,
    locally numbered rows are checkpointed to the shared checkpoint directory
    so the offsets and the rows come from the same materialisation, also when
    an executor is lost in between.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(group_cols) + _cols(order)
    local = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id()))
    local = (local.withColumn("_part", F.shiftright(F.col("_mid"), 33))
                  .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(LOW_BITS))))
    if checkpoint:
        local = local.checkpoint(eager=True)
    # One row per (task, group): bounded by tasks + groups.
    spans = local.groupBy("_part", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                                    F.min("_idx").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    out = (_join_spans(local, spans, ["_part", *group_cols])
                .withColumn(rank_col, (F.col("_idx") - F.col("_first") + F.col("_offset") + 1).cast("long")))
    return out.drop("_mid", "_part", "_idx", "_first", "_offset")
