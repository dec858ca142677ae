"""M2, M3, M8: hybrid hate-speech labelling.

A lexicon hit decides a message outright (label 1, confidence 0.99); every
other message gets the classifier's argmax and top probability.  The lexicon
sees the raw combined text, the classifier the ``model_clean`` text.

Scorers are pluggable: a scorer takes a DataFrame holding ``clean_text`` and
returns it with ``model_label`` (int) and ``model_confidence`` (double).  JVM
scorers (Spark ML) are applied to every row inside one projection; a scorer
that runs Python per batch, or is dear for another reason, sees the non-hit rows
only: the rows with their flag are written once to the shared folder, split by
the flag, and read back as two parts.  A Python UDF inside ``when`` would see
every row, and two filters over one input would run the lexicon twice.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CONFIDENCE_ON_HIT, keyword_hit
from ..functions.text import model_clean
from ..session import scratch_path

Scorer = Callable[[DataFrame], DataFrame]

PREDICTION_COLUMNS = ["text", "predicted_label", "confidence", "date_time", "source_database", "source_table"]


def label_table_scorer(labels: DataFrame, key: str, label_col: str = "toxic") -> Scorer:
    """Stand-in classifier: the class comes from a labelled table.

    Labelled rows score their class with probability 1.0; unlabelled rows get
    the uniform distribution, whose argmax is class 0 with probability 0.5.
    Joined on ``key`` with a plain equi-join: Spark broadcasts the label table
    only when its measured size is under the broadcast threshold and shuffles
    both sides otherwise.
    """
    lab = labels.select(F.col(key), F.col(label_col).cast("int").alias("_cls"))

    def score(df: DataFrame) -> DataFrame:
        j = df.join(lab, key, "left")
        return (j.withColumn("model_label", F.coalesce(F.col("_cls"), F.lit(0)))
                 .withColumn("model_confidence", F.when(F.col("_cls").isNotNull(), F.lit(1.0))
                                                  .otherwise(F.lit(0.5)))
                 .drop("_cls"))

    return score


def _split_once(base: DataFrame) -> DataFrame:
    """The flagged rows, written by flag and read back: each filter on the flag reads its own folder."""
    path = scratch_path(base.sparkSession, "labelling")
    base.write.partitionBy("keyword_hit").parquet(path)
    return base.sparkSession.read.schema(base.schema).parquet(path).select(*base.columns)


def label_column_scorer(label_col: str) -> Scorer:
    """The stand-in classifier where the class (or null) already is a column; the column is dropped."""
    def score(df: DataFrame) -> DataFrame:
        known = F.col(label_col).isNotNull()
        return (df.withColumn("model_label", F.coalesce(F.col(label_col).cast("int"), F.lit(0)))
                  .withColumn("model_confidence", F.when(known, F.lit(1.0)).otherwise(F.lit(0.5))).drop(label_col))

    return score


def hybrid_label(df: DataFrame, scorer: Scorer, text_col: str = "text", python_scorer: bool = False,
                 lexicon_variant: str = "reference") -> DataFrame:
    """M2: lexicon hit -> (1, 0.99), else classifier argmax / max probability."""
    base = df.withColumn("keyword_hit", keyword_hit(F.col(text_col), lexicon_variant))
    base = base.withColumn("clean_text", model_clean(F.col(text_col)))
    if python_scorer:
        saved = _split_once(base)
        hits = (saved.filter(F.col("keyword_hit"))
                     .withColumn("model_label", F.lit(None).cast("int"))
                     .withColumn("model_confidence", F.lit(None).cast("double")))
        scored = hits.unionByName(scorer(saved.filter(~F.col("keyword_hit"))))
    else:
        scored = scorer(base)
    return (scored.withColumn("predicted_label",
                              F.when(F.col("keyword_hit"), F.lit(1)).otherwise(F.col("model_label")).cast("int"))
                  .withColumn("confidence",
                              F.when(F.col("keyword_hit"), F.lit(CONFIDENCE_ON_HIT))
                               .otherwise(F.col("model_confidence")).cast("double"))
                  .drop("model_label", "model_confidence"))


def detection_counts(pred: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Total, hate_speech and safe counts (per group)."""
    return (pred.groupBy(*(group_cols or []))
                .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("predicted_label") == 1).alias("hate_speech"))
                .withColumn("safe", F.col("total") - F.col("hate_speech")))
