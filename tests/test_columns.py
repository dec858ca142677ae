import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgaudit.operators import columns as C
from msgaudit.plans.catalog import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("a, b, want", [
    ("int", "int", "int"), ("int", "bigint", "bigint"), ("boolean", "int", "bigint"), ("int", "double", "double"),
    ("decimal(9,2)", "int", "double"), ("float", "double", "double"), ("boolean", "string", "string"),
    ("double", "string", "string"), ("timestamp", "string", "string"), ("timestamp", "date", "string"),
    ("array<int>", "string", "string"), ("array<int>", "array<int>", "array<int>"), ("void", "date", "date"),
    ("void", "void", "void"), ("binary", "int", "string")])
def test_join_of_types(spark, a, b, want):
    kind = lambda s: T.NullType() if s == "void" else spark.createDataFrame([], f"x {s}").schema[0].dataType
    assert C.join_types(kind(a), kind(b)) == C.join_types(kind(b), kind(a)) == kind(want)


def test_union_over_types(spark):
    day = datetime.datetime(2025, 8, 21, 10, 30)
    frames = [spark.createDataFrame([(1, "five", 2)], "id long, body string, size int"),
              spark.createDataFrame([(2, 5, 2.5), (3, None, None)], "id int, body int, size double"),
              spark.createDataFrame([(4, True)], "id long, body boolean"),
              spark.createDataFrame([(5, [1, None, 2])], "id long, body array<int>"),
              spark.createDataFrame([(6, day)], "id long, body timestamp"),
              spark.createDataFrame([(7, 1.5)], "id long, body double")]
    out = C.union_by_name(frames)
    assert out.dtypes == [("id", "bigint"), ("body", "string"), ("size", "double")]
    got = {r["id"]: (r["body"], r["size"]) for r in out.collect()}
    assert got == {1: ("five", 2.0), 2: ("5", 2.5), 3: (None, None), 4: ("True", None), 5: ("[1,null,2]", None),
                   6: ("2025-08-21 10:30:00", None), 7: ("1.5", None)}


def flat(frames):
    return sorted(r["text"] for r in C.flatten_tables(frames).collect())


def test_a_column_is_text_if_it_is_text_in_some_table(spark):
    text = spark.createDataFrame([("five",), ("7",)], "body string")
    number = spark.createDataFrame([(5,), (None,)], "body int")
    assert flat([text, number]) == ["5", "7", "five"]
    assert flat([text.filter("body = '7'"), number]) == []          # only numbers
    truth = spark.createDataFrame([("True",), ("False",)], "body string")
    assert flat([truth]) == [] and flat([truth, number]) == ["5", "False", "True"]
    assert flat([truth, number.filter("body IS NULL")]) == []
    assert flat([number]) == [] and flat([number.limit(0)]) == []
    literal = spark.createDataFrame([("null",), ("3",)], "body string")  # an NA literal is no value
    assert flat([literal, number]) == []


def test_flatten_reads_every_table_twice_at_most(spark):
    plan = QUERIES["extract_flatten"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 6 and "Subquery" not in plan and "Exchange" not in plan


def test_facts_come_back_as_one_row_a_column(spark):
    frames = [spark.createDataFrame([(str(i), "x", "true") for i in range(50)], "text_a string, text_b string, text_c string"),
              spark.createDataFrame([(1, 2.0)], "text_a int, text_b double")]
    assert C.merged_text_columns(frames) == ["text_a", "text_b", "text_c"]
    assert C.text_columns(frames, ["text_a", "text_b", "text_c"]) == ["text_b"]
    assert C.text_columns(frames, []) == []
    nulls = spark.range(3).select(F.lit(None).alias("text_a"))
    assert C.merged_types([nulls, frames[0]])["text_a"] == T.StringType()
    assert flat([nulls, frames[0]]) == ["x"] * 50
