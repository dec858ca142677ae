import math
import random

import numpy as np
from pyspark.sql import functions as F

from msgaudit.llm import negatives as N

SCHEMA = ("vec_id long, label int, embedding array<double>, id long, score long, kind int, key long, block long, "
          "rows int, anchor long, lane int")
CLASH = (1, 2, 3, 4, 5, 6, 7, 8)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """All results by plain loops over (id, label, vector)."""
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
             if i is not None and l is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, va) in enumerate(whole):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l == label)
                        for k, (i, l, v) in enumerate(whole) if k != a)
        for s, i, same in [x for x in scored if x[2]][:positives]:
            below = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(anchor, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(below[:negatives])]
    return sorted(out)


def mined(df, every=50, **kw):
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def random_rows(seed, n, dims=6, labels=4, spread=1.0):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0.4, spread) for _ in range(dims)] for _ in range(labels)]
    return [(i, l := rnd.randrange(labels), [c + rnd.gauss(0, 0.3) for c in centre[l]]) for i in range(n)]


def test_agrees_with_loops(spark, monkeypatch):
    rows = random_rows(1, 700)
    want = brute(rows)
    assert len(want) > 40 and mined(frame(spark, rows)) == want
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)  # many blocks and lanes
    monkeypatch.setattr(N, "ANCHOR_ROWS", 3)
    assert mined(frame(spark, rows)) == want
    assert mined(frame(spark, rows), positives=2, negatives=4, low=20, high=90) == brute(rows, 50, 2, 4, 20, 90)


def test_ties_and_one_frequent_vector(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    same = [(i, i % 3, [0.5, 0.25, -0.125]) for i in range(0, 200)]
    near = [(i, i % 2, [0.4, 0.25, 0.0]) for i in range(200, 400)]
    flat = [(i, i % 2, [0.0, 0.0, 0.0]) for i in range(400, 460)]  # score 0: the window is 0 itself
    rows = same + near + flat
    assert mined(frame(spark, rows)) == brute(rows)


def test_awkward_rows(spark):
    rows = random_rows(2, 120) + [(None, 1, [1.0] * 6), (50, None, [1.0] * 6), (100, 1, None), (150, 2, [1.0, None]),
                                  (200, 1, [float("nan")] * 6), (250, 1, [float("inf"), 1.0]), (300, 1, []),
                                  (350, 1, [1.0, 2.0]), (50, 2, [0.3] * 6), (50, 2, [0.3] * 6), (-50, 0, [0.7] * 8)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, [])) == []
    only = [(50, 1, [1.0, 2.0]), (51, 1, [1.0, 2.0])]
    assert mined(frame(spark, only)) == []


def test_scores_are_exact_beyond_float64(spark):
    rows = [(0, 1, [3e9, 1.0]), (1, 1, [3e3, 0.5]), (2, 1, [3e3, 0.75]), (3, 2, [1.6e3, 3.0]), (4, 2, [1.6e3, 2.0])]
    assert mined(frame(spark, rows)) == brute(rows) != []
    huge = np.array([[1e300, 1.0]]), np.array([[1e300, 1.0], [-1e300, 0.0]])
    assert N.scores(*huge).tolist() == [[N.LIMIT, -N.LIMIT]]


def test_key_order():
    keys = [(a, s, k, i) for a in (-3, 0, 9) for s in (5, 0, -7) for k in (0, 1) for i in (-1, 0, 4)]
    packed = sorted(N.pack_key(*k) for k in keys)
    assert [N._unpack_key(p) for p in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_streams_hold_no_anchor():
    """The iterators read one pair at a time: a result leaves before the next anchor is read."""
    read = []

    def stream():
        for a in range(3):
            for pair in ((a, 100, 0, 1), (a, 90, 1, 2), (a, 80, 1, 3), (a, 10, 1, 4)):
                read.append(a)
                yield N.pack_key(*pair), a
    out = N.window_negatives(stream(), 3, 50, 95)
    assert next(out) == (0, 1, 1, 2, 100, 90) and set(read) == {0}
    assert len(list(out)) == 5
