"""Counts, per-platform statistics, roll-ups, modes, accuracy.

All aggregates are plain ``groupBy``/``rollup`` aggregations, so Spark runs a
partial (map-side) aggregation before the shuffle: a platform holding a third
of all messages costs one partial row per map task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_pct_string, py_strip, tenths_str

STAT_COLUMNS = ["total", "hate", "safe", "hate_pct", "safe_pct"]


def pct_tenths(part: Column, total: Column) -> Column:
    """round(part / total * 100, 1) as an integer number of tenths, half-even.

    Integer arithmetic gives the same answer in every engine; it differs from
    Python's float rounding only on exact ties (documented, 0.1 point).
    """
    p, t = part.cast("long"), total.cast("long")
    num = p * F.lit(1000)
    r = F.pmod(num, t)
    q = ((num - r) / t).cast("long")  # exact: the quotient is a whole number
    up = (r * 2 > t) | ((r * 2 == t) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(t > 0, q + F.when(up, 1).otherwise(0)).otherwise(F.lit(0).cast("long"))


def _finish(df: DataFrame) -> DataFrame:
    t = pct_tenths(F.col("hate"), F.col("total"))
    return (df.withColumn("safe", F.col("total") - F.col("hate"))
              .withColumn("_ht", t)
              .withColumn("hate_pct", F.col("_ht").cast("double") / F.lit(10.0))
              .withColumn("safe_pct", F.when(F.col("total") > 0,
                                             (F.lit(1000) - F.col("_ht")).cast("double") / F.lit(10.0))
                                       .otherwise(F.lit(0.0)))
              .drop("_ht"))


def hate_counts(df: DataFrame, group_cols: list[str], label_col: str = "predicted_label") -> DataFrame:
    """A1 + A3: total and label-1 count per group."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("total"),
                                       F.count_if(F.col(label_col) == 1).alias("hate"))


def platform_stats(df: DataFrame, platform_col: str = "platform",
                   label_col: str = "predicted_label") -> DataFrame:
    """A4 ``compute_stats`` for every platform at once."""
    return _finish(hate_counts(df, [platform_col], label_col))


def stats_for_dimension(df: DataFrame, dimension: DataFrame, platform_col: str = "platform",
                        label_col: str = "predicted_label") -> DataFrame:
    """A4 with zeros for platforms that have no rows (R2's fixed platform list).

    The dimension is a list of platform names (tiny); the aggregate has one
    row per platform, so the join is between two small relations.
    """
    counts = hate_counts(df, [platform_col], label_col)
    joined = (dimension.select(platform_col).join(counts, platform_col, "left")
              .select(platform_col, F.coalesce("total", F.lit(0)).alias("total"),
                      F.coalesce("hate", F.lit(0)).alias("hate")))
    return _finish(joined)


def overall_rollup(df: DataFrame, platform_col: str = "platform", label_col: str = "predicted_label",
                   total_name: str = "Total") -> DataFrame:
    """A5: per-platform rows plus a device-wide row computed from summed counts."""
    agg = (df.rollup(platform_col)
             .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label_col) == 1).alias("hate"),
                  F.grouping(platform_col).alias("_g")))
    agg = agg.withColumn(platform_col, F.when(F.col("_g") == 1, F.lit(total_name))
                                        .otherwise(F.col(platform_col))).drop("_g")
    return _finish(agg)


def summary_strings(stats: DataFrame) -> DataFrame:
    """``"{hate} = {hate_pct}%"`` / ``"{safe} = {safe_pct}%"`` cells."""
    ht = pct_tenths(F.col("hate"), F.col("total"))
    st = F.when(F.col("total") > 0, F.lit(1000) - ht).otherwise(F.lit(0))
    return stats.withColumns({
        "hate_cell": count_pct_string(F.col("hate"), ht),
        "safe_cell": count_pct_string(F.col("safe"), st),
        "hate_pct_cell": F.concat(tenths_str(ht), F.lit("%")),
        "safe_pct_cell": F.concat(tenths_str(st), F.lit("%")),
    })


def chart_series(stats: DataFrame, platform_col: str = "platform") -> DataFrame:
    """(platform, series, count) bars/pie slices from A4/A5 output."""
    return stats.select(platform_col, "hate", "safe").unpivot(
        [platform_col], ["hate", "safe"], "series", "count")


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2 ``value_counts``: count per label, most frequent first."""
    return (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(label_col)))


def mode_nonempty(df: DataFrame, cols: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """Most common stripped non-empty value of each column (per group).

    Ties go to the smallest value.  Counts per value are a partial-aggregated
    ``groupBy``; the winner per column is one ``min_by`` over the key
    ``(-count, value)``, so the input is read once and no column's distinct
    values are ever gathered in one task.
    """
    group_cols = list(group_cols or [])
    keys = group_cols + ["column"]
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    stacked = (df.select(*group_cols, F.explode(named).alias("_v"))
                 .select(*group_cols, "_v.column", py_strip(F.col("_v.value")).alias("value")))
    counts = (stacked.filter(F.col("value").isNotNull() & (F.col("value") != ""))
                     .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))
    return counts.groupBy(*keys).agg(F.min_by("value", order).alias("value"), F.max("n").alias("n"))


def first_candidate_mode(df: DataFrame, candidates: list[str], group_cols: list[str] | None = None) -> DataFrame:
    """The mode of the first candidate column (in order) that has one."""
    group_cols = list(group_cols or [])
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df.select(*group_cols, F.lit(None).cast("string").alias("column"),
                         F.lit(None).cast("string").alias("value")).limit(0)
    modes = mode_nonempty(df, present, group_cols)
    prio = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(c), F.lit(i))])
    ranked = modes.withColumn("prio", prio[F.col("column")])
    pick = ranked.groupBy(*group_cols).agg(F.min_by(F.struct("column", "value"), "prio").alias("m"))
    return pick.select(*group_cols, F.col("m.column").alias("column"), F.col("m.value").alias("value"))


def accuracy(df: DataFrame, pred_col: str, label_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return (df.groupBy(*(group_cols or []))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy")))


def first_candidate_mode_frames(dfs: list[DataFrame], candidates: list[str]) -> DataFrame:
    """A7 ``infer_device_from_dfs``: frames in order, candidates in order; the
    first (frame, column) whose mode is non-empty wins.  One row (or none)."""
    u = None
    for i, df in enumerate(dfs):
        present = [c for c in candidates if c in df.columns]
        if present:
            place = F.create_map(*[x for c in present for x in (F.lit(c), F.lit(i * len(candidates) + candidates.index(c)))])
            part = mode_nonempty(df, present).withColumn("prio", place[F.col("column")])
            u = part if u is None else u.unionByName(part)
    if u is None:
        raise ValueError("no candidate column in any frame")
    return u.agg(F.min_by(F.struct("column", "value"), "prio").alias("m")).select(
        F.col("m.column").alias("column"), F.col("m.value").alias("value")).filter(F.col("value").isNotNull())
