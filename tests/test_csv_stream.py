"""CSV conventions and the streaming job."""
import shutil

from pyspark.sql import functions as F

from msgaudit.operators.detect import label_table_scorer
from msgaudit.sources.csv import read_csv, write_csv
from msgaudit.streaming.detect_stream import labelled_stream, message_stream, start_counts
from msgaudit.plans.tables import read

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip_text_and_na(spark, tmp_path):
    vals = ['a "quoted"\nline', "  spaced  ", "null", "NA", "", None, "x,y", "crlf\r\nend"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, text string")
    path = str(tmp_path / "c")
    write_csv(df, path)
    back = {int(r.i): r.text for r in read_csv(spark, path, "i string, text string").collect()}
    assert back[0] == vals[0] and back[1] == vals[1] and back[6] == "x,y" and back[7] == vals[7]
    assert back[2] is None and back[3] is None and back[4] is None and back[5] is None


def test_missing_csv_is_empty(spark, tmp_path):
    assert read_csv(spark, str(tmp_path / "nope.csv"), "a string").count() == 0


def test_streaming_matches_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    shutil.copy(f"{SF}/documents.parquet", src / "part-0.parquet")
    docs = read(spark, SF, "documents")
    schema = docs.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    stream = message_stream(spark, str(src), schema).select(
        "doc_id", F.col("source").alias("platform"), "text")
    labelled = labelled_stream(stream, label_table_scorer(read(spark, SF, "labels"), "doc_id"))
    q = start_counts(labelled, "stream_counts", checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.platform: (r.total, r.hate) for r in spark.sql("SELECT * FROM stream_counts").collect()}
    from msgaudit.plans.catalog import QUERIES
    ref = {r.platform: (r.total, r.hate) for r in QUERIES["platform_stats"](spark, SF).collect()}
    assert got == ref
