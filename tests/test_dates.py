"""T1/T2 golden rows and the two date parsers agreeing."""
from pyspark.sql import functions as F

from msgaudit.functions import timestamps as T
from msgaudit.functions.coerce import to_numeric


def test_epoch_golden(spark):
    vals = ["1755734400", "1755734400000", "1755734400000000", "999999999", "abc", " 1755734400 "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    out = [r["d"] for r in df.select("i", F.date_format(T.epoch_to_date(to_numeric(F.col("s"))), "yyyy-MM-dd")
                                     .alias("d")).orderBy("i").collect()]
    assert out == ["2025-08-21", "2025-08-21", None, None, None, "2025-08-21"]


GOLDEN = {"0": "-", "08/21/2025": "2025-08-21", "21/08/2025": "2025-08-21", "2021": "2021-01-01", "12345": "-",
          "20210101": "2021-01-01", "03/04/2025": "2025-03-04", "Aug 21, 2025": "2025-08-21",
          "21 Aug 2025": "2025-08-21", "2025-08-21T23:00-05:00": "2025-08-21", "13/13/2025": "-",
          "02/30/2025": "-", "None": "-", "": "-", "2025/08/21 10:30": "2025-08-21", "1600": "-"}


def test_first_date_golden(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "sent string")
    got = {r["sent"]: r["d"] for r in T.with_nice_date(df, "d", ["sent"]).collect()}
    assert got == GOLDEN
    col_form = {r["sent"]: r["d"] for r in df.select("sent", T.nice_date(["sent"], df.schema).alias("d")).collect()}
    assert col_form == GOLDEN


def test_order_and_combo(spark):
    df = spark.createDataFrame([("None", "1755734400000", "x", "y"), ("0", "nan", "2025-08-21", "10:30:00")],
                               "created_at string, date_time string, date string, time string")
    out = [r["m"] for r in T.with_message_date(df, "m").collect()]
    assert out == ["21/08/2025", "21/08/2025"]
    combo = T.with_first_date(df.select("date", "time"), "c", [], combo=("date", "time"), fmt="yyyy-MM-dd", missing="-")
    assert [r["c"] for r in combo.collect()] == ["-", "2025-08-21"]


def test_nice_datetime_keeps_unparsable(spark):
    df = spark.createDataFrame([("2025-08-21",), ("soon",), (None,)], "s string")
    assert [r["o"] for r in df.select(T.nice_datetime("s").alias("o")).collect()] == ["21/08/2025", "soon", ""]
