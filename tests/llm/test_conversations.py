import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from msgaudit.llm import conversations as C
from msgaudit.llm.queries import op13_conversation_repair

SCHEMA = ("conv_id long, turn long, role string, text string, conv long, chunk long, seq string, kind long, copy int, "
          "gone boolean, lead long, _salt long")
CLASH = (1, 2, "x", 3, 4, True, 5, 6)
GOAL = re.compile("(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


def damaged(rows):
    """{conv: rows after damage, in order}, by plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else
                   "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, repaired lines) row by row over all states, whole strings kept."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for i in "ua":
                    if (state, i) in move:
                        new = (cost + 3, audit + "I", lines + [names[i] + ":"])
                        q = move[state, i]
                        if q not in ways or new[:2] < ways[q][:2]:
                            ways[q] = new
        return ways

    ways = {"": (0, "", [])}
    for (_, role, text), f in zip(rows, fault):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way
        for state, (cost, audit, lines) in inserted(ways).items():
            offer(state, (cost + 4, audit + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            extra = 3 if f == "truncated" else 0
            if (state, role[:1]) in move:
                offer(move[state, role[:1]], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
            for i in "ua":
                if (state, i) in move:
                    offer(move[state, i], (cost + 3 + extra, audit + "R", lines + [f"{names[i]}:{text}"]))
        ways = new
    ways = inserted(ways)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def brute(rows):
    out = []
    for conv, kept in damaged(rows).items():
        fault = faults(kept)
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(kept, fault)
        out.append((conv, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(df):
    out = C.repair(C.damage(df))
    assert out.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_rows(seed, convs=60, most=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "unknown", "", "Assistant"]
    texts = ["Hello there.", "So it is", "", None, " \t ", "Why?", "äöü!", " ", "one. two", "a.b!c?"]
    return [(c if c else None, rnd.choice([t, t, t, None, t * 3]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4
             else f"Row {rnd.randrange(50)}" + rnd.choice([".", "?", ""]))
            for c in range(convs) for t in range(rnd.randrange(1, most))]


def test_agrees_with_loops(spark):
    rows = some_rows(1)
    assert repaired(frame(spark, rows)) == brute(rows)


def test_long_conversations_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 7)
    monkeypatch.setattr(C, "FAN_IN_BITS", 1)
    rnd = random.Random(4)
    rows = some_rows(2, 20, 40) + [(500, t, rnd.choice(["user", "assistant"]), f"T{rnd.randrange(40)}" + rnd.choice([".", ""]))
                                   for t in range(300)]
    rows += [(501, 1, "user", "same")] * 200 + [(502, t, "user", "same row at every turn.") for t in range(150)]
    assert repaired(frame(spark, rows)) == brute(rows)


def test_awkward_rows(spark):
    assert repaired(frame(spark, [])) == []
    gone = [next((9, t, "user", "x") for t in range(500) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)]
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(frame(spark, gone)) == [(9, 0, 0, 0, 0, 0, 0, "", empty)]
    rows = [(None, None, None, None), (None, None, "user", "a."), (1, None, "user", "x" * 300_000 + "."), (2, 5, "", "no role."),
            (3, 2 ** 62, "system", "s."), (3, -2 ** 62, "user", "u."), (4, 1, "user", "q?"), (4, 1, "user", "q?"),
            (4, 1, "assistant", "b."), (5, 0, "s" * 200 + "1", "x."), (5, 0, "s" * 200 + "0", "x.")]
    got, want = repaired(frame(spark, rows)), brute(rows)
    assert [r for r in got if r[0] != 5] == [r for r in want if r[0] != 5] and len(got) == len(want)


def test_ties_take_the_least_audit():
    """All edit strings of short conversations, listed."""
    for n in range(4):
        for seq in product("suaoUx", repeat=n):
            best = None
            for total in range(n, 2 * n + 4):
                for edits in product("DIKR", repeat=total):
                    if sum(e != "I" for e in edits) != n:
                        continue
                    for picks in product("ua", repeat=sum(e in "IR" for e in edits)):
                        cost, made, at, pick = 0, "", 0, iter(picks)
                        for e in edits:
                            kind = seq[at] if e != "I" else ""
                            at += e != "I"
                            cost += {"D": 4, "I": 3, "K": 0, "R": 3}[e] + (3 if kind.isupper() and e != "D" else 0)
                            if e in "KR" and kind == "x":
                                cost = 10 ** 6
                            made += {"D": "", "K": kind.lower()}.get(e) if e in "DK" else next(pick)
                        if GOAL.fullmatch(made) and (best is None or (cost, "".join(edits)) < best):
                            best = cost, "".join(edits)
            assert C.finish(C.Grammar([]).product("".join(seq), C.IDENTITY[:1])[0]) == best, seq
        if n == 2:
            break


def test_grammar_changes_no_product(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("uauauasxoUA") for _ in range(rnd.randrange(0, 60))) for _ in range(80)] + ["ua" * 200]
    table = spark.createDataFrame([(t, rnd.randrange(1, 9)) for t in texts], "seq string, n long")
    grammar = C.repair_grammar(table)
    plain = C.Grammar([])
    assert len(grammar.rules) > 20 and len(grammar.compress("ua" * 200)) < 40
    for t in texts:
        whole = lambda g: [[e and (e[0], C.flat(e[1])) for e in line] for line in g.product(t)]
        assert whole(grammar) == whole(plain)
    done = grammar.compress("ua" * 200)
    expand = {n: a + b for n, a, b in grammar.rules}
    while any(c in expand for c in done):
        done = "".join(expand.get(c, c) for c in done)
    assert done == "ua" * 200
    assert C.repair_grammar(table.limit(0)).rules == []


@pytest.mark.parametrize("a, b", [("abc", "abd"), ("b", "ab"), ("x" * 40 + "a", "x" * 40 + "b")])
def test_ropes(a, b):
    cut = lambda s: C.join(C.join(s[:len(s) // 3], s[len(s) // 3:len(s) // 2] * 1), s[len(s) // 2:])
    force = lambda s: C.Rope(C.Rope(s[:1], s[1:2]), s[2:])
    assert C.flat(cut(a)) == a and C.flat(force(b)) == b
    assert C.before(force(a), cut(b)) == (a < b) and C.before(cut(b), force(a)) == (b < a)
    assert not C.before(force(a), cut(a))


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, sf)
    assert got.columns[0] == "conv_id" and sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
