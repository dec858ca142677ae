"""Incremental detection with Structured Streaming.

New evidence lands as Parquet files in a directory; each micro-batch is
labelled exactly like the batch job (lexicon hit, else the scorer) and
appended to a Parquet table partitioned by platform, while the per-platform
counts are kept as a streaming aggregation.  Checkpoints live under the
shared checkpoint directory, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Scorer, hybrid_label
from ..session import scratch_path


def message_stream(spark: SparkSession, source_dir: str, schema: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)


def labelled_stream(messages: DataFrame, scorer: Scorer) -> DataFrame:
    """M2 on a stream (stream-static joins and Arrow UDFs are both supported)."""
    return hybrid_label(messages, scorer)


def platform_counts(labelled: DataFrame) -> DataFrame:
    """Running total / hate per platform (partial aggregation per micro-batch)."""
    return labelled.groupBy("platform").agg(F.count(F.lit(1)).alias("total"),
                                            F.count_if(F.col("predicted_label") == 1).alias("hate"))


def start_detection(labelled: DataFrame, out_dir: str, checkpoint: str | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """Append labelled messages to ``out_dir`` (Parquet, partitioned by platform)."""
    spark = labelled.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-detect-ckpt")
    w = (labelled.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .partitionBy("platform").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_counts(labelled: DataFrame, table: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Keep the per-platform counts in an in-memory table (complete mode)."""
    spark = labelled.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-counts-ckpt")
    w = (platform_counts(labelled).writeStream.format("memory").queryName(table).outputMode("complete")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
