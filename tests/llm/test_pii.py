import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from msgaudit.llm import pii

from .helpers import frame, small


def by_contract(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="ab012.@+- (%é\n", max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == by_contract(text)


def test_base_examples():
    text = "é mail kim.lee+x@mail1.example.com, 4125346984640168 and +1 (453) 555-6570 from 71.224.97.88 not 300.1.1.1"
    assert pii.base_spans(text) == by_contract(text)
    assert [k for *_, k in pii.base_spans(text)] == ["email", "card", "phone", "ip"]
    long_part = "0" * 5000 + "1"  # more digits than Python turns into a number
    for text in (f"{long_part}.2.3.4", f"1.{long_part}.3.4", f"1.2.3.{long_part}", "1" * 5000 + ".2.3.4", f"0.0.{'0' * 6000}.0"):
        found = [s for s in pii.base_spans(text) if s[2] == "ip"]
        assert found == ([] if text.startswith("11") else [(0, len(text), "ip")])
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a@" * 20_000 + "b.c")[-1][2] == "email"


def test_gradients():
    rng = np.random.default_rng(0)
    net = pii.Tagger(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, tags = rng.integers(0, 128, (6, 3)), rng.integers(0, pii.TAGS, (6, 3))
    _, grads = net.learn(x, tags)
    for k, p in net.p.items():
        flat, g = p.reshape(-1), grads[k].reshape(-1)
        for i in np.argsort(-np.abs(g))[:2]:
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = net.learn(x, tags)[0]
            flat[i] = keep - 1e-4
            down = net.learn(x, tags)[0]
            flat[i] = keep
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3 * max(0.05, abs(g[i]))


def test_emissions_equal_the_training_pass():
    """Stacked directions against one direction after the other."""
    rng = np.random.default_rng(2)
    net = pii.Tagger(3)
    x, parts = rng.integers(0, pii.CLASSES, (23, 7)), []
    for d, way in (("f", slice(None)), ("b", slice(None, None, -1))):
        table = net.p["chars"] @ net.p[f"w{d}"] + net.p[f"b{d}"]
        parts.append(pii.lstm(table[x[way]], net.p[f"u{d}"])[0][way])
    want = np.concatenate(parts, 2) @ net.p["out"] + net.p["outb"]
    assert np.allclose(net.emissions(x.astype(np.uint8)), want.transpose(0, 2, 1), atol=1e-5)


def test_viterbi_finds_the_best_path_and_the_bound_is_safe():
    rng = np.random.default_rng(1)
    trans = rng.standard_normal((5, 5)).astype(np.float32)
    e = rng.standard_normal((5, 5, 6)).astype(np.float32)
    for b, path in enumerate(pii.viterbi(e, trans).T):
        best = max(itertools.product(range(5), repeat=5), key=lambda s: sum(e[t, s[t], b] for t in range(5))
                   + sum(trans[s[t], s[t + 1]] for t in range(4)))
        assert tuple(path) == best
    net = pii.Tagger(4)
    net.p["trans"] = trans
    x = rng.integers(0, 128, (40, 300))
    assert (net.decode(x) == pii.viterbi(net.emissions(x), trans)).all()


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(0)
    windows = []
    for k in range(600):
        text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(8))
        value = [f"x{rng.integers(99)}@mail{rng.integers(9)}.org", ".".join(map(str, rng.integers(0, 256, 4))), "4125346984640168",
                 f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", ""][k % 5]
        text = f"{text[:30]} {value} {text[30:]}"[:pii.TRAIN_WINDOW]
        windows.append((text, pii.base_spans(text)))
    return pii.fit(windows, steps=200)


def test_whole_texts_are_tagged(tagger):
    filler = "abc def gha bcd " * 200
    text = filler + "+1 (453) 555-6570 " + filler + "71.224.97.88 " + filler
    tags = pii.tag_texts(tagger, [text, "", "x"])
    assert [len(t) for t in tags] == [len(text), 0, 1]
    spans = pii.added_spans(text, tags[0], [])
    assert [(a, b) for a, b, _ in spans] == [(a, b) for a, b, _ in pii.base_spans(text)]


def test_found_spans_keep_the_base(spark, tagger):
    df = small(spark, [(1, "call +1 (453) 555-6570 now, or 453 555 6570 later"), (2, None), (3, "a@b.co a@b.co")])
    out = {r["id"]: r for r in pii.find(df, tagger).collect()}
    for i, t in ((1, "call +1 (453) 555-6570 now, or 453 555 6570 later"), (2, ""), (3, "a@b.co a@b.co")):
        base = pii.as_text(pii.base_spans(t))
        assert out[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(out[i]["spans"].split(","))
    assert out[3]["n_email"] == 2 and out[2]["spans"] == ""


def test_awkward_rows(spark):
    df = frame(spark)
    tagger = pii.train(df)
    assert pii.find(df, tagger).count() == df.count()
    assert pii.find(frame(spark, []), pii.train(frame(spark, []))).count() == 0


def test_windows_without_a_part_in_a_span_are_not_decoded(tagger, monkeypatch):
    read, decode = [], pii.Tagger.decode
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, x: (read.append(x.shape[1]), decode(self, x))[1])
    filler = "abc def gha bcd " * 200
    for at in range(270, 300, 3):  # across the border between two windows' decided parts
        text = filler[:at] + " +1 (453) 555-6570 " + filler
        read.clear()
        tags = pii.tag_texts(tagger, [filler, text, "no number"])
        assert [len(t) for t in tags] == [len(filler), len(text), 9] and sum(read) <= 3
        assert [s[:2] for s in pii.added_spans(text, tags[1], [])] == [s[:2] for s in pii.base_spans(text)]
    read.clear()
    assert not pii.tag_texts(tagger, [filler])[0].any() and not read
