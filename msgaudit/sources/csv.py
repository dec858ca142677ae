"""CSV source and sink with the reference's (pandas) conventions.

* Header row, RFC-4180 quoting with doubled quotes, fields spanning lines.
  ``multiLine`` is required for the last point and makes each file one task,
  so CSV is landed as Parquet right after reading (``land_as_parquet``).
* pandas reads a set of NA literals as missing; Spark keeps them as strings.
  ``read_csv`` applies the same rule to string columns.
* A missing input is not an error: an empty relation with the expected schema
  is returned (S3).
* Sink: Spark's writer trims whitespace and writes nulls as empty fields by
  default; both are switched to keep text exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import na_literals_to_null

READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
                "mode": "PERMISSIVE"}
WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                 # a file with quoted line ends is read by one task, so files are kept small enough for one
                 "maxRecordsPerFile": "500000"}


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema if schema is not None else T.StructType([]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_rule: bool = True) -> DataFrame:
    """S1 (+S3): a CSV file or directory the way pandas reads it.

    Columns go by their name in the header.  With a ``schema`` its columns come
    first, typed (a field that does not parse, or a column that is absent, is
    null), and other columns follow as text; without one every column is text
    and typing is left to the caller (``to_numeric``), since Spark's inference
    differs from pandas'.
    A missing path gives an empty relation instead of an error.
    """
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.options(**READ_OPTIONS).csv(path)  # every column is text, named by the header
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _empty(spark, schema)
        raise
    df = na_literals_to_null(df) if na_rule else df
    if schema is None:
        return df
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    known = {f.name for f in wanted.fields}
    typed = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    return df.select(*typed, *[F.col(f"`{c}`") for c in df.columns if c not in known])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + quoted text, nothing trimmed; files of bounded rows, so that reading them back spreads."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def land_as_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once as Parquet (optionally partitioned, e.g. by platform) and read back."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
