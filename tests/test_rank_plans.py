"""Ranking operators and plan shapes."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from msgaudit.operators import rank as K
from msgaudit.plans.tables import messages, scored_messages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_number_rows_equals_window(spark):
    d = messages(spark, SF).select("doc_id", "platform")
    ours = {(r.platform, r.doc_id): r.rank for r in K.number_rows(d, ["platform"], [F.asc("doc_id")], num_partitions=5).collect()}
    w = Window.partitionBy("platform").orderBy("doc_id")
    ref = {(r.platform, r.doc_id): r.rn for r in d.withColumn("rn", F.row_number().over(w)).collect()}
    assert ours == ref


def test_top_n_plans_take_ordered(spark):
    d = messages(spark, SF)
    assert "TakeOrderedAndProject" in plan(K.top_n(d, 25, [F.desc("doc_id")]))


def test_group_limit_before_shuffle(spark):
    d = messages(spark, SF)
    p = plan(K.top_n_per_group(d, ["platform"], [F.desc("doc_id")], 25))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(spark):
    d = scored_messages(spark, SF).select("doc_id", "predicted_label")
    p = d._jdf.queryExecution().executedPlan().toString()
    read = [line for line in p.split("\n") if "ReadSchema" in line and "documents.parquet" in line]
    assert read and all("n_chars" not in line.split("ReadSchema")[1] for line in read)


def test_python_only_where_expected(spark):
    d = scored_messages(spark, SF)
    p = plan(d)
    # the only Python node is the lexicon automaton (ArrowEvalPython)
    assert p.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in p


def test_hot_platform_numbering_is_split(spark):
    """One platform holds a third of the rows: numbering stays exact and the hot
    platform is spread over several range partitions (no single hot task)."""
    d = messages(spark, "/root/testdata/sf0.01").select(
        "doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("platform")).alias("platform"))
    ours = {(r.platform, r.doc_id): r.rank for r in K.number_rows(d, ["platform"], [F.asc("doc_id")], num_partitions=8).collect()}
    w = Window.partitionBy("platform").orderBy("doc_id")
    ref = {(r.platform, r.doc_id): r.rn for r in d.withColumn("rn", F.row_number().over(w)).collect()}
    assert ours == ref
    parts = (d.repartitionByRange(8, "platform", "doc_id").filter(F.col("platform") == "hot")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts >= 2


def test_spread_only_when_asked(spark):
    from msgaudit.session import SPREAD_CONF, spread
    one = spark.range(100).coalesce(1)
    assert spread(one) is one
    spark.conf.set(SPREAD_CONF, "true")
    try:
        assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset(SPREAD_CONF)


def test_numbering_keeps_null_keys(spark):
    from msgaudit.operators import rank as K
    rows = [("a", 3, "x"), ("a", None, "y"), (None, 2, "z"), (None, 1, "w"), ("a", 1, None), ("b", None, "q"), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, k int, t string")
    for numbered in (K.number_rows(df, ["g"], [F.asc("k"), F.asc("t")], bucket_key="k"),
                     K.number_rows(df, ["g"], [F.asc("k"), F.asc("t")], bucket_key="t")):
        got = sorted(((r.g or "", r["rank"], r.k, r.t) for r in numbered.collect()), key=lambda r: r[:2])
        assert got == [("", 1, None, None), ("", 2, 1, "w"), ("", 3, 2, "z"), ("a", 1, None, "y"), ("a", 2, 1, None),
                       ("a", 3, 3, "x"), ("b", 1, None, "q")]
    down = K.number_rows(df, ["g"], [F.desc("k"), F.asc("t")], bucket_key="k", bucket_desc=True)
    assert [(r.k, r["rank"]) for r in down.filter("g = 'a'").orderBy("rank").collect()] == [(3, 1), (1, 2), (None, 3)]



def test_flagged_topn_keeps_take_ordered(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["flagged_topn"](spark, SF))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_bucketed_numbering_matches_window(spark):
    d = messages(spark, "/root/testdata/sf0.01").select(
        "doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("platform")).alias("platform"))
    w = Window.partitionBy("platform").orderBy("doc_id")
    ref = {(r.platform, r.doc_id): r.rn for r in d.withColumn("rn", F.row_number().over(w)).collect()}
    asc = K.number_rows(d, ["platform"], [F.asc("doc_id")], bucket_key="doc_id", num_partitions=7)
    assert {(r.platform, r.doc_id): r.rank for r in asc.collect()} == ref
    wd = Window.partitionBy("platform").orderBy(F.desc("doc_id"))
    refd = {(r.platform, r.doc_id): r.rn for r in d.withColumn("rn", F.row_number().over(wd)).collect()}
    desc = K.number_rows(d, ["platform"], [F.desc("doc_id")], bucket_key="doc_id", bucket_desc=True, num_partitions=5)
    assert {(r.platform, r.doc_id): r.rank for r in desc.collect()} == refd
    p = plan(asc)
    assert "Window" in p and "ExistingRDD" not in p  # nothing checkpointed
