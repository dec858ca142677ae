"""Evidence files hold every document."""
from msgaudit.plans.evidence import NO_PLATFORM, build_databases


def test_documents_without_source_are_written(spark, tmp_path):
    rows = [(i, f"text {i}", "en", (None, "a", NO_PLATFORM)[i % 3], 6) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    _, written = build_databases(spark, str(tmp_path), rows_per_db=8)
    files = written.collect()
    assert sum(r["rows"] for r in files) == 30 and len({r["path"] for r in files}) == len(files)
    assert sum(r["rows"] for r in files if r["platform"] == NO_PLATFORM) == 20
