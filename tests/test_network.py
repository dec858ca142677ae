"""M5-M9: the network in epochs, the plug point, and the model as a table."""
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgaudit.functions.lexicon import keyword_hit
from msgaudit.functions.text import model_clean
from msgaudit.operators import network as N
from msgaudit.operators import relational as R
from msgaudit.operators.detect import hybrid_label

SF_SMALL = "/root/testdata/sf0.001"


def labelled(spark, n=240):
    good, bad = "green calm river stone field".split(), "rude ugly nasty vile foul".split()
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        rows.append((i, " ".join(rng.choice(bad if label else good, 4)) + " " + " ".join(rng.choice(["the", "a", "of"], 5)), label))
    rows += [(n, "", 0), (n + 1, None, 1), (n + 2, "http://only.link", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_word_ids_are_the_same_in_spark_and_python(spark):
    net = N.BagNet.fresh(buckets=977)
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(model_clean(F.col("text")).alias("t")).limit(50)
    for r in df.select("t", N.word_ids("t", 977).alias("ids")).collect():
        assert list(r["ids"] or []) == net.ids(r["t"] or "").tolist()


def test_gradients():
    net = N.BagNet.fresh(7, 3)
    for name in ("vectors", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    flat, sizes, labels = np.array([0, 1, 1, 4, 6]), np.array([3, 0, 2]), np.array([1, 0, 1])
    loss = lambda: -np.log(net.probabilities(flat, sizes)[np.arange(3), labels]).mean()
    words, out, bias = net.gradients(flat, sizes, labels)
    dense = np.zeros((7, 3))
    np.add.at(dense, flat, words)
    for array, grad in ((net.vectors, dense), (net.out, out), (net.bias, bias)):
        for at in np.ndindex(array.shape):
            keep, eps = array[at], 1e-6
            array[at] = keep + eps
            up = loss()
            array[at] = keep - eps
            down = loss()
            array[at] = keep
            assert abs((up - down) / (2 * eps) - grad[at]) < 2e-4


def test_scorer_equals_plain_evaluation_and_sees_no_hits(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "you idiot"), (-2, None), (-3, "")], docs.schema))
    net = N.BagNet.fresh(512, 8, seed=9)
    pred = hybrid_label(docs, N.network_scorer(spark, net.to_bytes()), python_scorer=True)
    rows = {r["doc_id"]: r for r in pred.collect()}
    assert len(rows) == docs.count() and rows[-1]["keyword_hit"]
    missed = [r for r in rows.values() if not r["keyword_hit"]]
    plain = net.predict([r["clean_text"] for r in missed])
    assert [r["predicted_label"] for r in missed] == plain["label"].tolist()
    assert np.allclose([r["confidence"] for r in missed], plain["confidence"], atol=1e-6)
    assert all(r["predicted_label"] == 1 and r["confidence"] == 0.99 for r in rows.values() if r["keyword_hit"])


def test_hits_are_never_sent_and_the_lexicon_runs_once(spark):
    df = spark.createDataFrame([(i, "you idiot" if i % 3 else "hello there") for i in range(60)], "doc_id long, text string")

    class Refuses:
        """A model that fails on any text with a lexicon hit."""

        def __init__(self, _):
            pass

        def predict(self, texts):
            assert not any("idiot" in (t or "") for t in texts)
            return {"label": np.zeros(len(texts), np.int32), "confidence": np.full(len(texts), 0.75)}

    pred = hybrid_label(df, N.network_scorer(spark, b"", load=Refuses), python_scorer=True)
    got = {r["doc_id"]: (r["predicted_label"], r["confidence"]) for r in pred.collect()}
    assert got == {i: (1, 0.99) if i % 3 else (0, 0.75) for i in range(60)}
    plan = pred._jdf.queryExecution().optimizedPlan().toString()
    assert "predict(" in plan and "hit(text" not in plan  # the written flag is read, the lexicon is not in the plan
    alone = df.select(keyword_hit(F.col("text")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "hit(text" in alone


def test_epochs_learn_and_the_best_is_read_back(spark, tmp_path):
    df = labelled(spark)
    train, validation = df.filter("doc_id % 5 <> 0"), df.filter("doc_id % 5 = 0")
    got = N.train_epochs(train, validation, f"file://{tmp_path}/run", epochs=4, buckets=256, dim=6, workers=3)
    assert len(got.losses) == 4 and got.best_epoch == int(np.argmin(got.losses)) + 1
    assert got.losses[got.best_epoch - 1] < 0.4 < math.log(2) + 0.1 and max(got.accuracies) > 0.9
    saved = spark.read.parquet(f"file://{tmp_path}/run/epoch-{got.best_epoch:03d}").first()
    assert bytes(saved["weights"]) == got.net.to_bytes() and saved["loss"] == got.losses[got.best_epoch - 1]


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    df = labelled(spark)
    train, validation = df.filter("doc_id % 5 <> 0"), df.filter("doc_id % 5 = 0")
    kw = dict(buckets=128, dim=4, workers=3)
    N.train_epochs(train, validation, f"file://{tmp_path}/a", epochs=2, **kw)
    for name in ("train", "validation"):  # the same encoded rows, no epochs yet
        shutil.copytree(tmp_path / "a" / name, tmp_path / "b" / name)
    whole = N.train_epochs(train, validation, f"file://{tmp_path}/b", epochs=4, **kw)
    # the third epoch was being written when the run was stopped: no mark of success
    torn = tmp_path / "a" / "epoch-003"
    torn.mkdir()
    (torn / "part-00000.parquet").write_bytes(b"torn")
    again = N.train_epochs(train, validation, f"file://{tmp_path}/a", epochs=4, **kw)
    assert again.best_epoch == whole.best_epoch and np.allclose(again.losses, whole.losses, atol=1e-6)
    assert np.allclose(again.net.vectors, whole.net.vectors, atol=1e-5)


def test_training_without_rows(spark, tmp_path):
    none = labelled(spark).limit(0)
    got = N.train_epochs(none, none, f"file://{tmp_path}/none", epochs=2, buckets=16, dim=2, workers=2)
    assert got.best_epoch == 1 and got.losses == [float("inf")] * 2
    assert [(r["term"], r["weight"]) for r in R.fit(none, steps=2).collect()] == [("", 0.0)]


# ------------------------------------------------------------ the model as a table

def plain_fit(rows, steps, rate, decay):
    """The same model by loops over dictionaries."""
    docs = [(k, [w for w in t.split(" ") if w], y) for k, t, y in rows]
    n, df = len(docs), {}
    for _, words, _ in docs:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in df.items()}
    xs = []
    for _, words, _ in docs:
        x = {w: words.count(w) * idf[w] for w in set(words)}
        length = math.sqrt(sum(v * v for v in x.values()))
        xs.append({w: v / length if length else 0.0 for w, v in x.items()})
    weight, bias = dict.fromkeys(idf, 0.0), 0.0
    for _ in range(steps):
        r = [1 / (1 + math.exp(-(sum(v * weight[w] for w, v in x.items()) + bias))) - y for x, (_, _, y) in zip(xs, docs)]
        g = dict.fromkeys(idf, 0.0)
        for x, e in zip(xs, r):
            for w, v in x.items():
                g[w] += v * e / n
        weight = {w: weight[w] - rate * (g[w] + decay * weight[w]) for w in weight}
        bias -= rate * sum(r) / n
    return idf, weight, bias


def test_relational_fit_equals_loops(spark, tmp_path):
    df = labelled(spark, 60).na.drop()
    clean = [(r["doc_id"], r["t"], r["label"]) for r in df.select("doc_id", model_clean(F.col("text")).alias("t"), "label").collect()]
    idf, weight, bias = plain_fit(clean, 3, 8.0, 1e-4)
    R.save(R.fit(df, steps=3), f"file://{tmp_path}/model")
    model = R.load(spark, f"file://{tmp_path}/model")
    got = {r["term"]: (r["idf"], r["weight"]) for r in model.collect()}
    assert got.pop("")[1] == pytest.approx(bias)
    assert {w: pytest.approx(v) for w, v in got.items()} == {w: (idf[w], weight[w]) for w in idf}
    other = spark.createDataFrame([(1, "vile foul green"), (2, "nothing known"), (3, None), (4, "the the the")], "doc_id long, text string")
    margins = {r["doc_id"]: r["margin"] for r in R.margins(model, other, "doc_id").collect()}
    assert margins[2] == margins[3] == pytest.approx(bias)
    x = {w: idf[w] for w in ("vile", "foul", "green")}
    length = math.sqrt(sum(v * v for v in x.values()))
    assert margins[1] == pytest.approx(sum(v * weight[w] for w, v in x.items()) / length + bias)


def test_table_scorer_learns(spark):
    df = labelled(spark).na.drop()
    model = R.fit(df.filter("doc_id % 4 <> 0"), steps=10)
    held = df.filter("doc_id % 4 = 0")
    pred = hybrid_label(held.select("doc_id", "text"), R.table_scorer(model, "doc_id")).join(held.select("doc_id", "label"), "doc_id")
    assert pred.filter("predicted_label = label").count() / held.count() > 0.9
    assert pred.filter("confidence < 0.5 OR confidence > 1").count() == 0


def test_relational_fit_with_few_frequent_terms(spark, monkeypatch):
    """Most terms meet the rows by a shuffle; repeated keys are one text with several labels, null keys none."""
    rows = [(1, "vile foul the", 1), (1, "the the", 0), (2, "green the calm", 0), (3, "foul ugly the", 1), (4, "", 0),
            (None, "vile green odd", 1), (None, "odd", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    whole = {r["term"]: (r["idf"], r["weight"]) for r in R.fit(df, steps=3).collect()}
    monkeypatch.setattr(R, "OFTEN", 2)
    few = R.fit(df, steps=3)
    terms = few.filter("term <> ''")
    assert 0 < terms.filter(F.col("idf") < R.often_below(terms)).count() <= 2 < terms.count()
    got = {r["term"]: (r["idf"], r["weight"]) for r in few.collect()}
    assert got.keys() == whole.keys() and all(got[t] == pytest.approx(whole[t]) for t in got)
    assert got["odd"][0] == pytest.approx(math.log(8 / 2))  # the rows without a key are one text
    margins = [(r["doc_id"], r["margin"]) for r in R.margins(few, df, "doc_id").collect()]
    assert len(margins) == 7 and all(m == pytest.approx(got[""][1]) for k, m in margins if k in (4, None))


def test_relational_shuffles_no_single_terms_for_the_gradient(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "k long, term string, tf long")
    idf = spark.createDataFrame([(0, "a", 0.5), (3, "b", 2.0)], "tid long, term string, idf double")
    out = {r["k"]: dict(zip(r["tids"], r["xs"])) for r in R.features(counts, idf, "k", F.col("idf") < 1).collect()}
    assert out == {1: {0: pytest.approx(1 / math.sqrt(5)), 3: pytest.approx(2 / math.sqrt(5))}, 2: {0: 1.0}}


def test_words_are_counted_where_the_texts_lie(spark):
    """One shuffle, that of the texts, and no aggregation of words; repeated keys are one text, also over several batches."""
    rows = [(k % 7 if k % 7 else None, " ".join(["b a", "A  c", "", "a"][:k % 5])) for k in range(40)] + [(9, None), (10, "")]
    df = spark.createDataFrame(rows, "k long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        counts = R.term_counts(df, "k")
        got = sorted((r["k"] or 0, r["term"], r["tf"]) for r in counts.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k, text in rows:
        for w in (text or "").lower().split():
            want[k or 0, w] = want.get((k or 0, w), 0) + 1
    assert got == sorted((*kw, n) for kw, n in want.items())
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan


def test_features_stay_where_they_lie(spark):
    """A step's residuals are shuffled to the rows of the features, which lie by key."""
    rows = spark.createDataFrame([(k, [k], [1.0]) for k in range(50)], "k long, tids array<long>, xs array<double>")
    x, table = R._by_key(rows.repartition(8, "k"), "k", 8, "features")
    residual = spark.createDataFrame([(k, float(k)) for k in range(50)], "k long, r double")
    both = x.join(residual.hint("shuffle_hash"), "k")
    assert sorted((r["k"], r["r"]) for r in both.collect()) == [(k, float(k)) for k in range(50)]
    assert both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    spark.sql(f"DROP TABLE {table}")


def test_rows_are_added_number_by_number():
    rng = np.random.default_rng(1)
    for ufunc in (np.add, np.subtract):
        rows, which = rng.normal(size=(7, 5)).astype(np.float32), rng.integers(0, 7, 200)
        values, want = rng.normal(size=(200, 5)).astype(np.float32), None
        want = rows.copy()
        ufunc.at(want, which, values)
        N._at(ufunc, rows, which, values)
        assert rows.tobytes() == want.tobytes()
    N._at(np.add, rows, np.empty(0, np.int64), np.empty((0, 5), np.float32))


def test_messages_are_dealt_out_before_scoring(spark):
    import __spark_entry__ as E
    from msgaudit.plans.tables import dealt, messages

    plan = E.queries()["bytes_literal"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    rows = messages(spark, SF_SMALL)
    assert sorted(dealt(rows, "doc_id", "text").collect()) == sorted(rows.collect())
