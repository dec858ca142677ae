"""Building the labelled training set and its train/validation split.

The three labelled sources of the reference differ in shape: one carries a
text verdict (``Offensive`` / ``Not offensive`` / other), two carry a numeric
label written as text.  Each is normalised to ``(text, label)`` with column
expressions and the three are unioned; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import map_values, to_numeric, truncate_int
from ..session import scratch_path
from .rank import number_rows_ranged

# Fixed values (must equal the reference): verdict words and their labels.
VERDICT_LABELS = {"Offensive": 1, "Not offensive": 0}

SPLIT_SEED = 42          # fixed value: the reference's random_state
VALIDATION_PERCENT = 20  # fixed value: test_size=0.2


def from_verdicts(df: DataFrame, text_col: str = "Sentence", verdict_col: str = "Hate_speech",
                  keep: list[str] | None = None) -> DataFrame:
    """Source with text verdicts: keep known verdicts (F1), map them (D6), rename (C4)."""
    keys = [F.lit(k) for k in VERDICT_LABELS]
    return (df.filter(F.col(verdict_col).isin(*keys))
              .select(*(keep or []), F.col(text_col).alias("text"),
                      map_values(F.col(verdict_col), VERDICT_LABELS).cast("int").alias("label")))


def from_numeric_labels(df: DataFrame, text_col: str = "comment", label_col: str = "label",
                        keep: list[str] | None = None) -> DataFrame:
    """Source with numeric labels as text: coerce (D1), drop unparsable (D3), truncate."""
    dtype = df.schema[label_col].dataType
    out = df.select(*(keep or []), F.col(text_col).alias("text"), to_numeric(F.col(label_col), dtype).alias("label"))
    return out.na.drop(subset=["label"]).withColumn("label", truncate_int(F.col("label")))


def merge_labelled(parts: list[DataFrame]) -> DataFrame:
    """U2 then D4: union of same-shaped sources, rows with any null dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.na.drop(how="any")


def split_bucket(key: Column, seed: int = SPLIT_SEED) -> Column:
    """0..99 from md5 of (seed, key): the same row always lands in the same fold,
    whatever the partitioning, and equal texts never straddle the folds."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


def assign_fold(df: DataFrame, key: str = "text", seed: int = SPLIT_SEED,
                validation_percent: int = VALIDATION_PERCENT) -> DataFrame:
    """M4: 80/20 train/validation by hash bucket (share is approximate)."""
    b = split_bucket(F.col(key), seed)
    return df.withColumn("fold", F.when(b < validation_percent, F.lit("validation")).otherwise(F.lit("train")))


#: Bits that one refinement of the selection tells apart: its histogram has at most 2 ** STEP_BITS rows.
STEP_BITS, HASH_BITS = 12, 60


def split_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    """60 bits of md5 of (seed, key), never negative."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def select_smallest(values: DataFrame, col: str, k: int, bits: int) -> tuple[int, int]:
    """The k-th smallest of non-negative numbers of ``bits`` bits, and how many are smaller.

    By refinement: a histogram over the leading bits says in which bucket the
    number lies, the next one looks only into that bucket.  Every histogram is
    one partial aggregation, of which at most 2 ** STEP_BITS rows come back.
    """
    prefix, before, left = 0, 0, bits
    while left:
        step = min(STEP_BITS, left)
        left -= step
        inside = values.filter(F.shiftright(col, left + step) == prefix) if prefix or left + step < bits else values
        histogram = inside.groupBy(F.shiftright(col, left).alias("bucket")).count().collect()
        for bucket, n in sorted(map(tuple, histogram)):
            if before + n >= k:
                prefix = bucket
                break
            before += n
    return prefix, before


def assign_exact_fold(df: DataFrame, key: str = "text", tie: str = "doc_id", seed: int = SPLIT_SEED,
                      validation_percent: int = VALIDATION_PERCENT) -> DataFrame:
    """M4 with an exact share: ceil(share * n) rows are the validation fold.

    The rows with the smallest hashes of ``key`` are taken, so equal texts stay
    together but for those of the last hash, of which the smallest ``tie``
    numbers (nulls first) fill the fold, and of rows equal in both as many as
    are missing.  Nothing is sorted: the last hash and the last tie are found
    by histograms over the slim (hash, tie) pairs, written once.
    """
    spark = df.sparkSession
    # the tie with its order kept as a number of 64 bits in two halves, nulls below all
    slim = df.select(split_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed).alias("h"),
                     F.col(tie).cast("long").alias("t"))
    path = scratch_path(spark, "split")
    slim.write.parquet(path)
    slim = spark.read.schema(slim.schema).parquet(path)
    n = slim.count()
    k = -(-n * validation_percent // 100)
    h = split_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    fold = lambda taken: F.when(taken, F.lit("validation")).otherwise(F.lit("train"))
    if not k:
        return df.withColumn("fold", F.lit("train"))
    last, before = select_smallest(slim, "h", k, HASH_BITS)
    same = slim.filter(F.col("h") == last)
    if before + same.count() == k:
        return df.withColumn("fold", fold(h <= last))
    # the ties of the last hash: the upper half of the shifted number first, then the lower one
    missing = k - before
    nulls = same.filter("t IS NULL").count()
    numbered = same.filter("t IS NOT NULL").select((F.shiftright("t", 32) + (1 << 31)).alias("high"),
                                                   F.col("t").bitwiseAND((1 << 32) - 1).alias("low"))
    if missing <= nulls:
        edge, smaller = F.col(tie).isNull(), F.lit(False)
        inside = missing
    else:
        high, fewer = select_smallest(numbered, "high", missing - nulls, 32)
        low, fewest = select_smallest(numbered.filter(F.col("high") == high), "low", missing - nulls - fewer, 32)
        value = ((high - (1 << 31)) << 32) | low
        edge = F.col(tie).cast("long") == value
        smaller = F.col(tie).isNull() | (F.col(tie).cast("long") < value)
        inside = missing - nulls - fewer - fewest
    edge, smaller = F.coalesce(edge, F.lit(False)), F.coalesce(smaller, F.lit(False))
    alike = df.filter((h == last) & edge)
    whole = df.filter(~((h == last) & edge)).withColumn("fold", fold((h < last) | ((h == last) & smaller)))
    if alike.count() == inside:
        return whole.unionByName(alike.withColumn("fold", F.lit("validation")))
    # rows equal in text and tie: any of them will do, as many as are missing
    order = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    numbered = number_rows_ranged(alike.withColumn("_one", F.lit(1)), ["_one"], order, "_rank")
    return whole.unionByName(numbered.withColumn("fold", fold(F.col("_rank") <= inside)).drop("_rank", "_one"))
