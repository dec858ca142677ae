"""The default sink, Parquet partitioned by platform.

A rerun replaces each platform that it writes as a whole (dynamic partition
overwrite) and leaves the others alone; a reader that asks for some platforms
lists and reads only their folders.  The folder is named by a key of the
platform, so null, empty and odd names come back as they were; ``platform``
itself stays a column of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION = "platform_key"
#: Rows of one file: a task that holds a hot platform writes several files.
ROWS_PER_FILE = 2_000_000


def partition_key(platform: Column) -> Column:
    """``-`` for no platform, ``+`` and the name otherwise."""
    return F.coalesce(F.concat(F.lit("+"), platform), F.lit("-"))


def write_by_platform(df: DataFrame, path: str, platform_col: str = "platform") -> None:
    """Writes ``df``; platforms that it holds are replaced."""
    (df.withColumn(PARTITION, partition_key(F.col(platform_col)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
       .partitionBy(PARTITION).parquet(path))


def read_by_platform(spark: SparkSession, path: str, schema: T.StructType, platforms: list[str | None] | None = None) -> DataFrame:
    """The rows of ``platforms`` (None among them: rows without one), or all; a missing path gives no rows."""
    from pyspark.errors import AnalysisException

    full = T.StructType([*schema.fields, T.StructField(PARTITION, T.StringType())])
    try:
        df = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if platforms is not None:
        df = df.filter(F.col(PARTITION).isin([("-" if p is None else "+" + p) for p in platforms]))
    return df.drop(PARTITION)
