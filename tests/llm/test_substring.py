import random
from collections import defaultdict

from msgaudit.llm import substring
from msgaudit.llm.exact_dedup import normalise

from .helpers import documents, frame, small, words


def test_bands_reach_the_recall():
    bands, rows = substring.tune()
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_every_shared_passage_is_found(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    rnd = random.Random(1)
    passage = words(rnd, 52, 99999)
    for k in range(6):
        w = words(rnd, 200, 99999).split()
        at = rnd.randrange(200)
        rows.append((1000 + k, " ".join(w[:at] + [passage] + w[at:])))
    seen, near = defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = normalise(t).split()
        for k in range(len(w) - 49):
            seen[tuple(w[k:k + 50])].add(i)
        for k in range(len(w) - 19):
            near[tuple(w[k:k + 20])].add(i)
    must = {i for v in seen.values() if len(v) > 1 for i in v}
    may = {i for v in near.values() if len(v) > 1 for i in v}
    found = substring.repeats(small(spark, rows))
    got = {r["id"] for r in found.collect()}
    assert must <= got <= may and set(range(1000, 1006)) <= got
    merged = substring.merged_spans(found).collect()
    texts = dict(rows)
    mine = [r for r in merged if r["id"] >= 1000]
    assert {r["first_id"] for r in mine} == {1000} and {r["id"] for r in mine if r["removed"]} == set(range(1001, 1006))
    assert all(len(texts[r["id"]][r["start"]:r["end"]].split()) >= 25 for r in merged)


def test_near_lines_are_linked(spark):
    rnd = random.Random(4)
    line = words(rnd, 60, 9999).split()
    other = list(line)
    other[30] = "changed"
    rows = [(1, "intro\n" + " ".join(line)), (2, "else\n" + " ".join(other)), (3, words(rnd, 80, 9999))]
    out = [r for r in substring.repeats(small(spark, rows)).collect() if r["kind"] == "line"]
    assert {r["id"] for r in out} == {1, 2} and {r["class"] for r in out if r["id"] == 1} == {r["class"] for r in out if r["id"] == 2}
    assert [r["removed"] for r in sorted(out, key=lambda r: r["id"])] == [False, True]


def test_equal_lines_are_found_in_different_texts(spark):
    """Lines too short for an aligned paragraph, and as the whole text."""
    rnd = random.Random(8)
    lines = [words(rnd, n, 99999) for n in (26, 40) for _ in range(10)]
    rows = [(100 * k + i, "\n".join((words(rnd, 30, 99999), line, words(rnd, 30, 99999))))
            for k, line in enumerate(lines) for i in range(2)]
    rows += [(5000 + i, text) for i, text in enumerate([words(rnd, 40, 99999)] * 2)]
    out = [r for r in substring.repeats(small(spark, rows)).collect() if r["kind"] == "line"]
    texts = dict(rows)
    got = {(r["id"], texts[r["id"]][r["start"]:r["end"]]) for r in out}
    assert got == {(i, t if i >= 5000 else lines[i // 100]) for i, t in rows}
    assert {r["id"] for r in out if r["removed"]} == {i for i, _ in rows if i % 100 == 1}


def test_rows_without_an_id_or_with_a_shared_one_are_documents(spark):
    rnd = random.Random(11)
    passage = words(rnd, 60, 99999)
    text = lambda: f"{words(rnd, 20, 99999)} {passage} {words(rnd, 20, 99999)}"
    for ids in ((None, None), (5, 5), (None, 3), (1, 2)):
        rows = [(i, text()) for i in ids]
        out = substring.merged_spans(substring.repeats(small(spark, rows))).collect()
        assert sorted((r["id"] is None, r["id"] or 0) for r in out) == sorted((i is None, i or 0) for i in ids)
        assert sorted(r["removed"] for r in out) == [False, True]
    twice = [(7, text())] * 2  # equal in id and text: one document
    assert substring.repeats(small(spark, twice)).count() == 0


def test_merged_spans_keep_every_class(spark):
    """Two passages with different first occurrences, side by side in a third document."""
    rnd = random.Random(12)
    a, b = words(rnd, 60, 99999), words(rnd, 60, 99999)
    rows = [(1, a + " " + words(rnd, 30, 99999)), (2, words(rnd, 30, 99999) + " " + b), (3, a + " " + b)]
    found = substring.repeats(small(spark, rows)).collect()
    merged = [r for r in substring.merged_spans(substring.repeats(small(spark, rows))).collect() if r["id"] == 3]
    assert {x["first_id"] for r in merged for x in r["repeats"]} == {1, 2}
    assert {(x["kind"], x["class"]) for r in merged for x in r["repeats"]} == {(r["kind"], r["class"]) for r in found if r["id"] == 3}


def test_awkward_rows(spark):
    df = frame(spark)
    out = substring.merged_spans(substring.repeats(df)).collect()
    ids = {r["id"] for r in out}
    assert {None, 1, 2, 11, 7, 8} <= ids and not ids & {4, 5, 6, 10, 12, 13}
    assert substring.repeats(frame(spark, [])).count() == 0
