import random

import numpy as np
import pytest

from msgaudit.llm import toxicity

from .helpers import frame, small


def text(rnd, toxic, n=None):
    w = ["".join(rnd.choice(["an", "ed", "ti", "on", "re", "sh"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n or rnd.randrange(5, 150))]
    for _ in range(max(1, len(w) // 60) if toxic else 0):
        w[rnd.randrange(len(w))] = "Zog" + rnd.choice(["an", "ed", "ti", "on"]) * rnd.randrange(1, 3) + rnd.choice(["", ".", "!"])
    return " ".join(w)


@pytest.fixture(scope="module")
def net():
    rnd = random.Random(0)
    return toxicity.fit([(text(rnd, k % 4 == 0), int(k % 4 == 0)) for k in range(400)], rounds=4, steps=60)


def test_gradients():
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    windows, y, weight = [[b"hello", b"you"], [b"a", b"b", b"c"]], np.array([1.0, 0.0]), np.ones(2)
    _, grads = net.learn(windows, y, weight)
    for k, p in net.p.items():
        flat, g = p.reshape(-1), grads[k].reshape(-1)
        for i in np.argsort(-np.abs(g))[:2]:
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = net.learn(windows, y, weight)[0]
            flat[i] = keep - 1e-4
            down = net.learn(windows, y, weight)[0]
            flat[i] = keep
            assert abs((up - down) / 2e-4 - g[i]) < 1e-3 * max(0.01, abs(g[i]))


def test_held_out_accuracy_on_new_word_forms(net):
    rnd = random.Random(9)
    texts = [(text(rnd, k % 2 == 0), k % 2 == 0) for k in range(200)]
    score = toxicity.Scorer(net)([t for t, _ in texts])
    hits = (score >= toxicity.THRESHOLD) == np.array([y for _, y in texts])
    assert hits.mean() >= 0.97


def test_whole_texts_count(net):
    rnd = random.Random(4)
    clean = text(rnd, False, 3000)
    scorer = toxicity.Scorer(net)
    assert scorer([clean])[0] < 0.3 <= scorer([clean + " Zogon " + text(rnd, False, 10)])[0]


def test_batches_do_not_change_scores(net, monkeypatch):
    rnd = random.Random(5)
    texts = [text(rnd, k % 3 == 0) for k in range(40)] + [None, "", "x" * 5000]
    whole = toxicity.Scorer(net)(texts)
    monkeypatch.setattr(toxicity.Scorer, "LIMIT", 50)
    scorer = toxicity.Scorer(net)
    assert np.allclose(whole, np.concatenate([scorer([t]) for t in texts]), atol=1e-5)


def test_windows_cover_every_word():
    for n in (1, 63, 64, 65, 112, 113, 500):
        _, first, size = toxicity.windows_of([n])
        assert set(range(n)) == {w for f, s in zip(first, size) for w in range(f, f + s)} and size.max() <= toxicity.WINDOW


def test_training_reads_only_rows_that_are_not_held_out(spark):
    rnd = random.Random(1)
    rows = [(k, text(rnd, k % 3 == 0)) for k in range(120)]
    # labels of held-out rows are inverted: learning from them would show
    labels = spark.createDataFrame([(k, int((k % 3 == 0) != toxicity.held_out(k)), 1) for k in range(120)] + [(None, 1, 1), (5, None, 1)],
                                   "doc_id long, toxic int, quality int")
    df = small(spark, rows)
    out = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(out) == 120 and all(r["held_out"] == toxicity.held_out(r["id"]) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([(r["score"] >= 0.3) == (r["id"] % 3 == 0) for r in out]) > 0.9


def test_awkward_rows(spark, net):
    df = frame(spark)
    assert toxicity.score(df, net).count() == df.count()
    kept = toxicity.keep_clean(df, net)
    assert kept.columns == df.columns and kept.count() <= df.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.train(frame(spark, []), none)
    assert toxicity.score(frame(spark, []), empty).count() == 0 and toxicity.keep_clean(frame(spark, []), empty).count() == 0
    assert all(r["score"] < 0.3 for r in toxicity.score(df, toxicity.train(df, none)).collect())
