import hashlib
import random

from msgaudit.llm import iblt

from .helpers import frame, small


def jaccard(a, b):
    a, b = set(a.split("\n")), set(b.split("\n"))
    return len(a & b) / len(a | b)


def check(df, rows):
    """Against brute force; rows in id order."""
    out = {(r["id"], r["n_chars"], r["fingerprint"]): r for r in iblt.fingerprints(df).collect()}
    got = sorted(out.values(), key=lambda r: (r["id"] is not None, r["id"] or 0))
    assert len(got) == len(rows)
    for k, (r, (doc, text)) in enumerate(zip(got, rows)):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        assert (r["id"], r["n_chars"], r["edited_sha256"]) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(text, edited)) < 1e-9 and abs(r["near_next"] - jaccard(text, nxt)) < 1e-9
        assert len(r["lost"]) == len(set(text.split("\n")) - set(edited.split("\n")))
        assert len(r["gained"]) == len(set(edited.split("\n")) - set(text.split("\n")))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(k, "\n".join(f"line {rnd.randrange(50)} é" for _ in range(rnd.choice([1, 3, 12, 60, 400])))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 100_000), (103, "\n\n\n")]
    check(small(spark, rows).repartition(5), rows)


def test_larger_tables_recover_everything(spark):
    many = lambda a, b: list(range(a, b))
    sets = [(1, many(0, 5), many(3, 9)), (2, many(0, 500), many(250, 900)), (3, [], []), (4, many(0, 40), []), (5, [7], [7])]
    scramble = lambda xs: [(x * 0x9E3779B97F4A7C15 + 12345) % 2 ** 63 for x in xs]
    df = spark.createDataFrame([(r, scramble(a), scramble(b)) for r, a, b in sets], "row long, a array<long>, b array<long>")
    got = {r["row"]: {(g["k"], g["s"]) for g in r["got"]} for r in iblt.differences(df).collect()}
    for r, a, b in sets:
        a, b = set(scramble(a)), set(scramble(b))
        assert got[r] == {(x, 1) for x in a - b} | {(x, -1) for x in b - a}


def test_equal_texts_equal_fingerprints_and_one_row(spark):
    out = iblt.fingerprints(frame(spark)).collect()
    by_size = {}
    for r in out:
        by_size.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(out) == 17 and len(by_size[0]) == 1
    one = iblt.fingerprints(small(spark, [(1, "a\nb")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_empty_table(spark):
    assert iblt.fingerprints(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = iblt.fingerprints(small(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
