from msgaudit.llm import mixing

from .helpers import documents, frame, small


def targets(sizes):
    """Water level by bisection; sizes by ordered source."""
    weight = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    total, lo, hi = sum(sizes), 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(3 * s, mid * w) for s, w in zip(sizes, weight)) < total:
            lo = mid
        else:
            hi = mid
    return [min(3 * s, hi * w) for s, w in zip(sizes, weight)]


def check(rows, out):
    sources = sorted({r["source"] for r in out}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in out if r["source"] == s) for s in sources}
    for s, t in zip(sources, targets([size[s] for s in sources])):
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - t) <= 1e-6 * max(t, 1) and r["source_size"] == size[s] for r in mine)
        taken, largest = sum(r["copies"] * r["size"] for r in mine), max(r["size"] for r in mine)
        assert abs(taken - t) <= largest + 1e-6
        assert all(0 <= r["copies"] <= 3 for r in mine)
        rate = t / size[s] if size[s] else 0
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 for r in mine)


def test_targets_and_copies(spark):
    rows = [(d["doc_id"], d["text"], d["source"]) for d in documents()]
    df = small(spark, rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    check(rows, out)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["id"], r["copies"]) for r in out) == sorted((r["id"], r["copies"]) for r in again)


def test_awkward_rows(spark):
    df = frame(spark)
    out = mixing.mix(df).collect()
    assert len(out) == df.count()
    check(None, out)
    mixed = mixing.emit(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.emit(frame(spark, [])).count() == 0
    empty = mixing.mix(small(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert all(r["target"] == 0 and r["copies"] == 0 for r in empty)


def test_hot_source_is_capped(spark):
    rows = [(k, "a b c", "z") for k in range(300)] + [(1000, "a b", "a")]
    out = {r["id"]: r for r in mixing.mix(small(spark, rows)).collect()}
    assert out[1000]["target"] == 6 and out[1000]["copies"] == 3
    assert abs(out[0]["target"] - (902 - 6)) < 1e-9
