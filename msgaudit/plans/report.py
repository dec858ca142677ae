"""The relations behind the report pages (no drawing).

The reference renders these into a PDF; here each page's data is a
DataFrame so it can be written, checked or rendered by any tool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.coerce import fill_defaults
from ..functions.timestamps import with_message_date
from ..operators import rank as K
from ..operators import stats as A
from ..operators.columns import first_present
from ..sources.csv import read_csv

# Fixed values (must equal the reference): the report's platforms, in order.
REPORT_PLATFORMS = ["Facebook", "Instagram", "Messenger"]

# Fixed values (must equal the reference): columns that may hold the account
# name, in the order they are tried; then columns that may name the device.
HANDLE_CANDIDATES = ["username", "user_name", "sender_username", "profile_username", "handle", "owner_username",
                     "author", "author_name", "sender", "sender_name", "from", "from_name", "profile_name",
                     "account_name", "screen_name", "name", "full_name"]
DEVICE_CANDIDATES = ["device_model", "device", "model", "phone_model", "product_model",
                     "ro_product_model", "ro_product_name", "manufacturer", "device_name"]

PREDICTION_SCHEMA = ("text string, predicted_label string, confidence string, date_time string, "
                     "source_database string, source_table string")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """R1 ``load_df``: CSV with pandas' NA rule, defaults, numeric coercion, cleaned text."""
    df = fill_defaults(read_csv(spark, path, PREDICTION_SCHEMA))
    return df.withColumn("text", X.report_clean(F.col("text")))


def summary_table(pred: DataFrame, platforms: DataFrame) -> DataFrame:
    """R2: one row per platform of the dimension (zeros when absent), with the cells."""
    return A.summary_strings(A.stats_for_dimension(pred, platforms, "platform"))


def overall_table(pred: DataFrame) -> DataFrame:
    """Per-platform percentages plus the device-wide Total row."""
    return A.summary_strings(A.overall_rollup(pred, "platform"))


def platform_summary(pred: DataFrame, handles: DataFrame) -> DataFrame:
    """Statistics and the inferred account handle of each platform."""
    return A.platform_stats(pred, "platform").join(handles.select("platform", "handle"), "platform", "left")


def source_order(pred: DataFrame) -> list[str]:
    """Columns that give the order in which messages were read: file, table, row."""
    return [c for c in ("path", "table_pos", "row_id") if c in pred.columns]


def all_texts_listing(pred: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every message, numbered per platform in source order (file by file, table by table).

    ``pred`` holds ``path``, ``row_id`` and, where a file has several tables,
    ``table_pos``, or its ``rank`` already (messages numbered before they were
    labelled); ``keep`` names further columns to pass through.
    """
    if "rank" not in pred.columns:
        pred = K.number_in_source_order(pred, ["platform"], [c for c in ("path", "table_pos") if c in pred.columns])
    numbered = X.with_report_clean_twice(with_message_date(pred, "date"), "text", "listing_text")
    return numbered.select(
        "platform", "rank", *(keep or []),
        F.when(F.col("predicted_label") == 1, F.lit("Hate")).otherwise(F.lit("Safe")).alias("verdict"), "listing_text", "date",
        X.soft_wrap("source_database").alias("source_database"), X.soft_wrap("source_table").alias("source_table"))


def flagged_listing(pred: DataFrame, top_n: int = 25, tiebreak: list[str] | None = None) -> DataFrame:
    """Per platform, the top-N hate messages by confidence, ties in source order."""
    flagged = pred.filter(F.col("predicted_label") == 1)
    top = K.top_n_per_group(flagged, ["platform"], [F.desc("confidence"), *map(F.asc, tiebreak or source_order(pred))], top_n)
    top = with_message_date(top, "date")
    return top.select(
        "platform", "rank", X.confidence_percent(F.col("confidence")).alias("confidence"),
        X.reduce_code_blobs(X.report_clean(F.col("text"))).alias("text"), "date",
        X.soft_wrap("source_database").alias("source_database"), X.soft_wrap("source_table").alias("source_table"))


def hash_appendix(hashes: DataFrame) -> DataFrame:
    """Database / hash columns picked by name (C5), soft-wrapped."""
    cols = hashes.columns
    db = first_present(cols, ["database_file", "file", "database", "db"], 0)
    hs = first_present(cols, ["sha256_hash", "sha256", "hash", "sha_256"], 1)
    return hashes.select(X.soft_wrap(db).alias("database"), X.soft_wrap(hs).alias("hash"))


def chart_series(pred: DataFrame) -> DataFrame:
    """hate/safe counts per platform and overall (bars and pies)."""
    return A.chart_series(A.overall_rollup(pred, "platform"), "platform")


def console_summary(pred: DataFrame) -> DataFrame:
    """Total / hate / safe per platform."""
    return A.hate_counts(pred, ["platform"]).withColumn("safe", F.col("total") - F.col("hate"))


def report_platforms(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The fixed dimension of the summary table (R2): its platforms, whether they have messages or not."""
    return spark.createDataFrame([(p,) for p in names or REPORT_PLATFORMS], "platform string")


def infer_handles(messages: DataFrame, group_cols: list[str] | None = None,
                  order_col: str = "row_id") -> DataFrame:
    """A7 ``infer_username`` per platform: the normalised mode of the first
    candidate column that has one (X13); otherwise a database name found in
    ``source_database`` (X14), first in row order."""
    group_cols = list(group_cols or ["platform"])
    named = A.first_candidate_mode(messages, HANDLE_CANDIDATES, group_cols)
    named = named.select(*group_cols, X.normalise_handle(F.col("value")).alias("handle"))
    if "source_database" not in messages.columns:
        return named
    name = X.name_from_path(F.col("source_database"))
    by_path = (messages.select(*group_cols, name.alias("n"), F.col(order_col).alias("o")).filter(F.col("n") != "")
                       .groupBy(*group_cols).agg(F.min_by("n", "o").alias("path_handle")))
    return (by_path.join(named, group_cols, "full")
                   .select(*group_cols, F.coalesce(F.col("handle"), F.col("path_handle")).alias("handle")))


def infer_device(frames: list[DataFrame]) -> DataFrame:
    """A7 ``infer_device_from_dfs``: at most one row (column, value)."""
    return A.first_candidate_mode_frames(frames, DEVICE_CANDIDATES)


def flagged_rows(pred: DataFrame, top_n: int = 20, tiebreak: list[str] | None = None) -> DataFrame:
    """K1: label-1 rows, highest confidence first, the first ``top_n`` (a report limit)."""
    flagged = pred.filter(F.col("predicted_label") == 1)
    return K.top_n(flagged, top_n, [F.desc("confidence"), *map(F.asc, tiebreak or source_order(pred))])


def all_rows_sample(pred: DataFrame, top_n: int = 25, tiebreak: list[str] | None = None) -> DataFrame:
    """K2: the ``top_n`` longest texts (a report limit)."""
    return K.top_n(pred, top_n, [F.desc(F.length("text")), *map(F.asc, tiebreak or source_order(pred))])
