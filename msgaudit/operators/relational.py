"""M5, M6, M8, M9: a linear classifier whose model is a table.

* M5 encode: (row, tids, xs) from whitespace words of the ``model_clean`` text,
  arrays of numbered terms to a row; term frequency times ln((n + 1) / (df + 1)),
  each row scaled to length 1.
* M6 fit: logistic regression by gradient steps over all rows.  A step is two
  joins and two aggregations: terms with their weights give each row's margin,
  rows with their residual give each term's gradient.  Only the first takes the
  terms apart before its shuffle; for the second the rows lie in a table bucketed
  by key, so only the residuals move, and terms are summed where the rows are.  Every step's weights are written, which cuts the lineage and
  survives lost executors.
* M9 the model is a relation (term, idf, weight), the intercept under the empty
  term, which no word is; saved and loaded as Parquet, readable by any engine.
* M8 score: words join the model, one aggregation per text.

The vocabulary grows with the texts, so none is collected or broadcast whole: only
the most frequent terms, at most ``OFTEN``, are joined where the rows lie, which is
where most of the rows are; the rest are joined by term, at any size.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_clean
from ..session import scratch_path

STEPS, RATE, DECAY = 20, 8.0, 1e-4
INTERCEPT = ""
#: So many terms at most, the most frequent ones, are joined where the rows lie; bounded, whatever the vocabulary.
OFTEN = 100_000
#: So many rows at most, on average, lie in a partition of the features.
ROWS_OF_PART = 20_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_key(df: DataFrame, key: str, parts: int, name: str) -> tuple[DataFrame, str]:
    """``df``, dealt by ``key`` over ``parts`` partitions, written as a table that lies so; and the table's name."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "msgaudit_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(table)
    return spark.table(table), table


def _words(text_col: str) -> Column:
    return F.explode(F.split(model_clean(F.col(text_col)), " "))


#: Counted words that leave a task at once.
AT_ONCE = 100_000


def _count_words(batches):
    """(key, term, tf) of (key, words) rows that come in the order of their keys; a repeated key has the words of all its rows."""
    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())],
                                          names=[name, "term", "tf"])

    keys, terms, tfs, last, seen = [], [], [], None, Counter()

    def close():
        seen.pop("", None)
        keys.extend([last] * len(seen))
        terms.extend(seen.keys())
        tfs.extend(seen.values())

    for batch in batches:
        name, kind = batch.schema.names[0], batch.schema.types[0]
        for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != last:
                close()
                last, seen = key, Counter()
            seen.update((words or "").split(" "))
            if len(keys) >= AT_ONCE:
                yield out()
                keys, terms, tfs = [], [], []
    close()
    if keys:
        yield out()


def term_counts(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, term, tf): the words of each text and how often they stand in it.

    The texts are dealt out by key and lie in its order, so their words are
    counted where they are, a key at a time.
    """
    shape = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return (df.select(key, text_col).repartition(key).sortWithinPartitions(key).select(key, model_clean(F.col(text_col)).alias("words"))
              .mapInArrow(_count_words, shape))


def often_below(terms: DataFrame) -> float:
    """The idf below which at most ``OFTEN`` terms lie, from a histogram of a few hundred rows (idf is a logarithm)."""
    seen, cut = 0, float("-inf")
    for step, n in sorted(map(tuple, terms.groupBy(F.floor(F.col("idf") * 8)).count().collect())):
        seen += n
        if seen > OFTEN:
            break
        cut = (step + 1) / 8
    return cut


def inverse_frequencies(terms: DataFrame, n: int) -> DataFrame:
    """(term, idf) with ln((n + 1) / (df + 1)) of the (term) rows, one to a key."""
    return terms.groupBy("term").agg(F.log(F.lit(n + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("idf"))


def _meet(rows: DataFrame, rare: DataFrame, table: DataFrame, often: Column, on: str) -> DataFrame:
    """``rows`` with the frequent part of ``table`` where they lie, and ``rare`` rows with the rest of it by a shuffle."""
    return rows.join(F.broadcast(table.filter(often)), on).unionByName(rare.join(table.filter(~often).hint("shuffle_hash"), on))


def features(counts: DataFrame, idf: DataFrame, key: str, often: Column, parts: int | None = None) -> DataFrame:
    """(key, tids, xs): tf * idf, the rows scaled to length 1; rows of length 0 stay 0.  ``idf`` is (term, idf, tid).
    The rows are dealt by key, over ``parts`` partitions if given."""
    rare = counts.join(F.broadcast(idf.filter(often).select("term")), "term", "left_anti")
    raw = _meet(counts, rare, idf, often, "term").select(key, "tid", (F.col("tf") * F.col("idf")).alias("x"))
    rows = raw.repartition(*[parts] * (parts is not None), key).groupBy(key).agg(F.collect_list(F.struct("tid", "x")).alias("t"),
                                                 F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return rows.select(key, F.col("t.tid").alias("tids"), F.transform("t.x", lambda x: F.when(
        F.col("length") > 0, x / F.col("length")).otherwise(F.lit(0.0))).alias("xs"))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(train: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "label", steps: int = STEPS,
        rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """The model (term, idf, weight) of rows (key, text, label); ``key`` is unique.  No rows give the intercept 0 alone."""
    spark = train.sparkSession
    n = train.count()
    # a repeated key has one text, the words of all its rows, and the labels of all of them
    labels = _written(train.groupBy(key).agg(F.count(label_col).alias("m"), F.sum(F.col(label_col).cast("double")).alias("y")),
                      "model-labels")
    named, unnamed = train.filter(F.col(key).isNotNull()), train.filter(F.col(key).isNull())
    counts = _written(term_counts(named, key, text_col), "model-counts")
    # rows without a key meet no margin; together they are one text in the frequencies
    terms = counts.select("term").unionAll(unnamed.select(_words(text_col).alias("term")).filter(F.col("term") != "").distinct())
    found = _written(inverse_frequencies(terms, n), "model-frequencies")
    cut = often_below(found)
    # the lowest bit of a term's number says whether it is frequent
    idf = _written(found.withColumn("tid", F.monotonically_increasing_id() * 2 + (F.col("idf") < cut).cast("long")), "model-idf")
    # lies by key, so a step's residuals come to the rows and the rows stay
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_OF_PART))
    x, table = _by_key(features(counts, idf, key, F.col("idf") < cut, parts), key, parts, "model-features")
    often = F.col("tid").bitwiseAND(1) == 1
    entries = lambda rows, by: (rows.select(by, F.explode(F.arrays_zip("tids", "xs")).alias("t"))
                                    .select(by, F.col("t.tids").alias("tid"), F.col("t.xs").alias("x")))
    weights, intercept = idf.select("tid", F.lit(0.0).alias("w")), 0.0
    for k in range(steps if n else 0):
        each = entries(x, key)
        margin = (_meet(each.filter(often), each.filter(~often), weights, often, "tid")
                  .groupBy(key).agg(F.sum(F.col("x") * F.col("w")).alias("z")))
        residual = _written(labels.join(margin, key, "left").select(
            key, "m", (F.col("m") * _sigmoid(F.coalesce("z", F.lit(0.0)) + F.lit(intercept)) - F.coalesce("y", F.lit(0.0))).alias("r")),
            f"model-residual-{k}")
        gradient = (entries(x.join(residual.hint("shuffle_hash"), key), "r").groupBy("tid")
                    .agg((F.sum(F.col("x") * F.col("r")) / F.lit(float(n))).alias("g")))
        weights = _written(weights.join(gradient.hint("shuffle_hash"), "tid", "left").select(
            "tid", (F.col("w") - F.lit(rate) * (F.coalesce("g", F.lit(0.0)) + F.lit(decay) * F.col("w"))).alias("w")),
            f"model-weights-{k}")
        total, rows = residual.agg(F.sum("r"), F.sum("m")).first()
        intercept -= rate * total / rows
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files are the scratch folder's
    bias = spark.createDataFrame([(INTERCEPT, 0.0, float(intercept))], "term string, idf double, weight double")
    return idf.join(weights.hint("shuffle_hash"), "tid").select("term", "idf", F.col("w").alias("weight")).unionByName(bias)


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, idf double, weight double").parquet(path)


def margins(model: DataFrame, df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, margin) of every row of ``df`` (``key`` unique); words that the model lacks say nothing."""
    intercept = model.filter(F.col("term") == INTERCEPT).select("weight").first()  # one number
    named = df.filter(F.col(key).isNotNull())  # one without a key finds no sums
    counts, often = term_counts(named, key, text_col), F.col("idf") < often_below(model)
    rare = counts.join(F.broadcast(model.filter(often).select("term")), "term", "left_anti")
    known = _meet(counts, rare, model, often, "term").withColumn("x", F.col("tf") * F.col("idf"))
    sums = known.groupBy(key).agg(F.sum(F.col("x") * F.col("weight")).alias("s"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return df.select(key).join(sums, key, "left").select(
        key, (F.when(F.col("length") > 0, F.col("s") / F.col("length")).otherwise(F.lit(0.0))
              + F.lit(intercept["weight"] if intercept else 0.0)).alias("margin"))


def table_scorer(model: DataFrame, key: str):
    """M8 as a scorer for ``hybrid_label``: class and top probability from the model's table."""
    def score(df: DataFrame) -> DataFrame:
        p = _sigmoid(F.col("margin"))
        found = margins(model, df, key).select(key, (F.col("margin") > 0).cast("int").alias("model_label"),
                                               F.greatest(p, F.lit(1.0) - p).alias("model_confidence"))
        return df.join(found, key)

    return score
