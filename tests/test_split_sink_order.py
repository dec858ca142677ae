"""M4 with an exact share, S2 the sink by platform, K4/R5 in source order."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from msgaudit.operators import dataset as D
from msgaudit.operators import rank as K
from msgaudit.plans.report import all_texts_listing
from msgaudit.sources.sink import PARTITION, read_by_platform, write_by_platform


def folds(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    out = D.assign_exact_fold(df, "text", "doc_id", **kw)
    assert out.columns == ["doc_id", "text", "label", "fold"]
    return [tuple(r) for r in out.collect()]


def order_of(row):
    h = int(hashlib.md5(f"42:{row[1] or ''}".encode()).hexdigest()[:15], 16)
    return h, row[0] is not None, row[0] or 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 101])
def test_share_is_exact(spark, n):
    rnd = random.Random(n)
    rows = [(i, f"text {rnd.randrange(max(1, n // 2))}", i % 2) for i in range(n)]
    got = folds(spark, rows)
    assert sorted(r[:3] for r in got) == sorted(rows)
    want = sorted(rows, key=order_of)[:-(-n // 5)]
    assert sorted(r[:3] for r in got if r[3] == "validation") == sorted(want)


def test_equal_texts_split_by_id_only_where_the_count_says(spark):
    rows = [(i * 7919 - 40_000, "the same text", 0) for i in range(50)] + [(None, "the same text", 1)] * 3
    got = folds(spark, rows)
    taken = [r for r in got if r[3] == "validation"]
    assert len(taken) == 11 and sum(r[0] is None for r in taken) == 3
    assert sorted(r[0] for r in taken if r[0] is not None) == sorted(i * 7919 - 40_000 for i in range(8))
    mixed = [(i, f"t{i // 4}", 0) for i in range(40)]
    validation = {}
    for r in folds(spark, mixed):
        validation.setdefault(r[1], set()).add(r[3])
    assert sum(len(v) == 2 for v in validation.values()) <= 1


def test_rows_equal_in_all_columns(spark):
    got = folds(spark, [(1, "x", 0)] * 23)
    assert sorted(r[3] for r in got) == ["train"] * 18 + ["validation"] * 5
    assert sum(r[3] == "validation" for r in folds(spark, [(None, None, None)] * 9)) == 2


def test_kth_smallest(spark):
    rnd = random.Random(1)
    for bits in (1, 12, 13, 32, 60):
        values = [rnd.randrange(1 << bits) for _ in range(200)] + [0, (1 << bits) - 1, 0]
        df = spark.createDataFrame([(v,) for v in values], "h long")
        for k in (1, 2, 3, 100, len(values)):
            last, before = D.select_smallest(df, "h", k, bits)
            assert last == sorted(values)[k - 1] and before == sum(v < last for v in values)


def test_a_rerun_replaces_its_platforms_whole(spark, tmp_path):
    path, schema = f"file://{tmp_path}/sink", "platform string, n int"
    names = ["a", None, "", "x=y/z %", "+", "-"]
    first = spark.createDataFrame([(p, i) for p in names for i in range(3)], schema)
    write_by_platform(first, path)
    write_by_platform(spark.createDataFrame([("a", 9), (None, 8)], schema), path)
    got = sorted(((r["platform"], r["n"]) for r in read_by_platform(spark, path, first.schema).collect()), key=str)
    assert got == sorted([("a", 9), (None, 8)] + [(p, i) for p in names[2:] for i in range(3)], key=str)
    for p in names:
        some = read_by_platform(spark, path, first.schema, [p])
        assert {r["platform"] for r in some.collect()} == {p} and some.columns == ["platform", "n"]
    both = read_by_platform(spark, path, first.schema, ["a", None])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert PARTITION in plan and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(both.inputFiles()) >= 2 and both.count() == 2
    assert read_by_platform(spark, f"file://{tmp_path}/none", first.schema).collect() == []


def written_in_files(spark, tmp_path, files):
    """Files whose names are in another order than the numbers in them."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "n long, platform string").coalesce(1).write.parquet(f"file://{tmp_path}/t/f{k}")
    return K.with_position(spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/t"))


def test_numbers_follow_files_and_rows(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    files = [[(rnd.randrange(10 ** 6), rnd.choice(["hot", "hot", "hot", "b", None])) for _ in range(n)] for n in (300, 0, 70, 1)]
    df = written_in_files(spark, tmp_path, files)
    for bits in (16, 4):
        monkeypatch.setattr(K, "SPAN_BITS", bits)
        out = K.number_in_source_order(df, ["platform"], ["path"]).collect()
        place, want = {}, []
        for rows in files:
            for n, p in rows:
                place[p] = place.get(p, 0) + 1
                want.append((p, place[p], n))
        assert sorted(((r["platform"], r["rank"], r["n"]) for r in out), key=str) == sorted(want, key=str)


def test_listing_in_source_order(spark, tmp_path):
    df = written_in_files(spark, tmp_path, [[(5, "a"), (3, "a")], [(4, "a"), (1, "b")]])
    pred = df.select("platform", "path", "row_id", F.concat(F.lit("message "), F.col("n").cast("string")).alias("text"),
                     (F.col("n") % 2).cast("int").alias("predicted_label"), F.lit("2025-08-21").alias("date_time"),
                     F.lit("x_y.db").alias("source_database"), F.lit("t").alias("source_table"))
    got = sorted(tuple(r) for r in all_texts_listing(pred).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("a", 1, "Hate", "message 5"), ("a", 2, "Hate", "message 3"),
                                                       ("a", 3, "Safe", "message 4"), ("b", 1, "Hate", "message 1")]
    assert {r[4:] for r in got} == {("21/08/2025", "x_​y.db", "t")}
