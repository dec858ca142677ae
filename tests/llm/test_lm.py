import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from msgaudit.llm import lm

from .helpers import documents, frame, small


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def brute(rows):
    """Base score and Kneser-Ney score of every row, in plain Python."""
    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    words = Counter(w for t in train for w in t)
    n, v = sum(words.values()), len(words)
    pairs = Counter(p for t in train for p in zip([None] + t[:-1], t))
    total, kinds, before = Counter(), defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (h, w), c in pairs.items():
        total[h] += c
        kinds[h][min(c, 3)] += 1
        before[w] += 1
    counts = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    d, e = lm.discounts(*counts(pairs.values())), lm.discounts(*counts(before.values()))
    types = sum(before.values())
    left = sum(e[min(x, 3)] for x in before.values()) / types if types else 1.0

    def low(w):
        return (max(before[w] - e[min(before[w], 3)], 0) / types if types else 0) + left / (v + 1)

    def p(h, w):
        if not total[h]:
            return low(w)
        c = pairs[h, w]
        return max(c - d[min(c, 3)], 0) / total[h] + sum(d[k] * kinds[h][k] for k in (1, 2, 3)) / total[h] * low(w)
    out = []
    for i, t in rows:
        t = tokens(t)
        out.append((i, len(t), sum(w in words for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t),
                    sum(math.log10(p(h, w)) for h, w in zip([None] + t[:-1], t))))
    return out, lambda h: sum(p(h, w) for w in words) + p(h, b"unseen word")


@pytest.mark.parametrize("heavy", [False, True])
def test_against_brute_force(spark, heavy, monkeypatch):
    if heavy:  # many parts, so that frequent histories are spread over them
        monkeypatch.setattr(lm, "PART_TOKENS", 500)
    rows = [(d["doc_id"], d["text"]) for d in documents()][:80 if heavy else 200]
    df = small(spark, rows)
    want, mass = brute(rows)
    got = {r["id"]: r for r in lm.train(df).score(df).collect()}
    assert len(got) == len(rows)
    for i, n, known, train, base, score in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert abs(r["base_score"] - base) < 1e-6 * n and abs(r["score"] - score) < 1e-6 * n
    assert abs(mass(None) - 1) < 1e-9


def test_awkward_rows(spark):
    df = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want, _ = brute(rows)
    got = lm.train(df).score(df).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], round(t[4], 6))
    for a, r in zip(sorted(want, key=key), sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"],
                                                    r["score"]) for r in got), key=key)):
        assert a[:4] == r[:4] and abs(a[4] - r[4]) < 1e-6 * a[1] and abs(a[5] - r[5]) < 1e-6 * a[1]


def test_empty_table_and_nothing_to_learn_from(spark):
    empty = frame(spark, [])
    assert lm.train(empty).score(empty).count() == 0
    held = next(i for i in range(99) if lm.held_out(i))
    df = small(spark, [(held, "some text")])
    r = lm.train(df).score(df).first()
    assert r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["held_out"]


def test_tokens_are_numbered_as_they_are_looked_up():
    words = lm.Words(None, [])
    words.find = lambda hashes: hashes
    assert words.locate([b"y", b"x", b"y", b"z"]).tolist() == [0, 1, 0, 2] and words.locate([b"a", b"x"]).tolist() == [3, 1]
    assert words.ids.tolist() == lm.word_hashes([b"y", b"x", b"z", b"a"]).tolist()
    keys = np.random.default_rng(2).integers(0, 90, 500).astype(np.uint64)
    found, order, first = lm._distinct(keys)
    want, n = np.unique(keys, return_counts=True)
    assert (found == want).all() and (np.diff(np.append(first, 500)) == n).all() and (keys[order[first]] == want).all()
