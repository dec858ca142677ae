"""Binding of the engine's relations to the driver's parquet tables.

Stand-ins (SURVEY §7.3): a *platform* is ``documents.source``; the classifier
is the labelled table ``labels.toxic`` (``label_table_scorer``) unless a
trained Spark ML model is plugged in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import hybrid_label, label_table_scorer
from ..session import scratch_path, spread, table_path


# Tables whose rows carry long text: regex work on them is CPU-bound, so a
# session may ask for them to be dealt out first (``msgaudit.spread``).
TEXT_TABLES = {"documents", "conversations", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if name in TEXT_TABLES else df


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """The rows dealt out before dear steps, by the hash of ``cols``: a table may lie in one row group, which one task reads."""
    return df.repartition(*cols)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as evidence messages: (doc_id, platform, text, lang)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("platform"), "text", "lang")


def scored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 over every document with the label-table scorer."""
    labels = read(spark, sf_dir, "labels")
    return hybrid_label(messages(spark, sf_dir), label_table_scorer(labels, "doc_id"))


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform dimension: every source that has messages."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("platform")).distinct()


# --- derived inputs (deterministic decorations of the driver tables) ------------------

# Junk fragments appended to conversation turns so the report's
# prefix/suffix rules have work to do (one per rule, plus none).
NOISE_SUFFIXES = ["", " fts.db messages_content x", " reverb_db_1", " local_message_pe", " direct.db  messages",
                  " crypto_db9", " omnistore_x", " enigma.db", "\n((0 B))"]


def _pick(idx, options):
    expr = None
    for i, o in enumerate(options):
        v = o if not isinstance(o, str) else F.lit(o)
        expr = F.when(idx == i, v) if expr is None else expr.when(idx == i, v)
    return expr


def noisy_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with evidence-style noise around every turn's text."""
    c = read(spark, sf_dir, "conversations")
    prefix = _pick(F.pmod(F.col("turn"), F.lit(3)), ["", F.concat(F.col("conv_id").cast("string"), F.lit(" ")), "* "])
    suffix = _pick(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(NOISE_SUFFIXES))), NOISE_SUFFIXES)
    return c.select("conv_id", "turn", F.concat(prefix, F.col("text"), suffix).alias("noisy"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a message table: ``content`` text role, ``timestamp_ms`` time role."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("props").alias("content"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
                    F.col("event_type").alias("kind"))


def labelled_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three labelled sources in the reference's three shapes, from documents ⋈ labels.

    The documents are split by language (every document lands in exactly one
    source): English carries text verdicts, French/German numeric labels with
    unusable values, all others (and no language) numeric labels written as decimals.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    english, european = F.col("lang") == "en", F.col("lang").isin("fr", "de")
    shape = F.when(english, F.lit("verdict")).when(european, F.lit("number")).otherwise(F.lit("decimal"))
    # joined and written once: each source reads its own folder
    path = scratch_path(spark, "labelled")
    docs.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("shape", shape).write.partitionBy("shape").parquet(path)
    joined = spark.read.schema("doc_id long, text string, quality int, toxic int, shape string").parquet(path)
    verdict = (F.when(F.col("toxic") == 1, F.lit("Offensive"))
                .when(F.col("quality") == 1, F.lit("Not offensive")).otherwise(F.lit("Unsure")))
    s1 = joined.filter("shape = 'verdict'").select("doc_id", F.col("text").alias("Sentence"), verdict.alias("Hate_speech"))
    s2 = joined.filter("shape = 'number'").select(
        "doc_id", F.col("text").alias("comment"),
        F.when(F.col("quality") == 0, F.lit("n/a")).otherwise(F.col("toxic").cast("string")).alias("label"))
    s3 = joined.filter("shape = 'decimal'").select(
        "doc_id", F.col("text").alias("comment"), F.concat(F.col("toxic").cast("string"), F.lit(".0")).alias("label"))
    return [s1, s2, s3]
