"""M2 hybrid labelling: lexicon overrides the classifier; Python scorers see only non-hit rows."""
from pyspark.sql import functions as F

from msgaudit.operators.detect import hybrid_label


def test_keyword_overrides_model(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "hello there")], "id long, text string")

    def scorer(d):
        return d.withColumn("model_label", F.lit(0)).withColumn("model_confidence", F.lit(0.8))

    got = {r.id: (r.predicted_label, r.confidence) for r in hybrid_label(df, scorer).collect()}
    assert got == {1: (1, 0.99), 2: (0, 0.8)}


def test_python_scorer_only_sees_non_hits(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "hello there"), (3, "short")], "id long, text string")

    def score_batches(batches):
        for pdf in batches:
            assert not pdf["clean_text"].str.contains("idiot").any()
            pdf["model_label"] = (pdf["clean_text"].str.len() > 6).astype("int32")
            pdf["model_confidence"] = 0.7
            yield pdf

    def scorer(d):
        from pyspark.sql import types as T
        schema = T.StructType(d.schema.fields + [T.StructField("model_label", T.IntegerType()),
                                                 T.StructField("model_confidence", T.DoubleType())])
        return d.mapInPandas(score_batches, schema)

    got = {r.id: (r.predicted_label, r.confidence) for r in hybrid_label(df, scorer, python_scorer=True).collect()}
    assert got == {1: (1, 0.99), 2: (1, 0.7), 3: (0, 0.7)}


def test_build_and_train_flow(spark, tmp_path):
    from msgaudit.operators.train import load, model_scorer
    from msgaudit.plans.jobs import build_and_train

    words = ["you idiot fool", "lovely day", "stupid idiot", "nice work", "idiot again", "good morning"] * 20
    verdicts = spark.createDataFrame(
        [(w + f" {i}", "Offensive" if "idiot" in w else ("Not offensive" if i % 7 else "Unsure"))
         for i, w in enumerate(words)], "Sentence string, Hate_speech string")
    numeric = spark.createDataFrame([(w + f" n{i}", "1" if "idiot" in w else ("0.0" if i % 5 else "bad"))
                                     for i, w in enumerate(words)], "comment string, label string")
    res = build_and_train([verdicts], [numeric], model_path=str(tmp_path / "model"))
    assert res.merged.filter("label NOT IN (0, 1)").count() == 0
    assert res.merged.count() == len(words) * 2 - sum(1 for i in range(len(words)) if i % 7 == 0 and "idiot" not in words[i]) \
        - sum(1 for i in range(len(words)) if i % 5 == 0 and "idiot" not in words[i])
    assert res.val_accuracy >= 0.9
    scorer = model_scorer(load(str(tmp_path / "model")))
    probe = spark.createDataFrame([("stupid idiot friend",)], "clean_text string")
    assert scorer(probe).first().model_label == 1


def test_report_listing_helpers(spark):
    from msgaudit.plans.report import all_rows_sample, flagged_rows
    df = spark.createDataFrame([(i, "x" * i, 1 if i % 2 else 0, 0.5 + i / 100) for i in range(1, 41)],
                               "row_id long, text string, predicted_label int, confidence double")
    top = [r.row_id for r in flagged_rows(df).collect()]
    assert len(top) == 20 and top[0] == 39 and all(i % 2 for i in top)
    longest = [r.row_id for r in all_rows_sample(df).collect()]
    assert longest[:3] == [40, 39, 38] and len(longest) == 25
