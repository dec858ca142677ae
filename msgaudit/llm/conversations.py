"""Conversation structure repair by dynamic programming over a Re-Pair grammar.

The rows of a conversation, in the order of their turns, become symbols: the
initial of the role (system, user, assistant, other) and the first fault of the
row.  The cheapest edits that give a conversation of the form ``(s?(ua)+)?``
are a product of 4 x 4 min-plus matrices, one per symbol, whose entries hold a
cost and the edits' initials; of equal costs the ASCII-least initials win.  (Two
edit strings of one cost between the same states are never prefixes of each
other: the longer would only add paid insertions.  So the order of strings is
kept under concatenation and the product is associative.)

1. Rows are range-sorted by conversation and turn and cut into chunks of bounded
   rows and bytes; a hot conversation lies in many chunks of many tasks.
2. Re-Pair over all chunks' symbol strings: each round counts adjacent pairs in
   Spark, weighted by how many chunks share a string, and the most frequent
   pairs become rules.  Only the chosen pairs come to the driver.
3. Each rule's matrix is the product of its two halves' matrices, built bottom-up
   once per worker and shared by all conversations.  Audits are ropes: a product
   links two ropes instead of copying them.
4. A conversation that lies in one chunk is finished there.  The chunks of longer
   ones are combined in a tree of groups of bounded size; the audit is then cut at
   the chunks' borders, every chunk repairs its own rows, and the repaired texts
   are hashed in order by a stream that holds one chunk.

Defined results: null conversations are one conversation, null turns come first,
null roles and texts are one space; rows of equal turn are ordered by role and
text (the first 64 characters of either, then a hash).  A role without
characters, like one with another initial, cannot be kept.  A conversation of
which no row is left has zeros, an empty audit and the hash of the empty string.
Its audit is one value, so a conversation may have some 10**8 rows.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, bound_batches

#: Rows and bytes of text of a chunk.
CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20
#: Chunks or groups combined at once.
FAN_IN_BITS = 4
#: Rounds of Re-Pair, rules chosen in each, and the least count of a pair worth a rule.
ROUNDS, RULES_A_ROUND, LEAST_COUNT = 12, 16, 2

# The costs of the edits, and the languages' states (nothing yet, after s, after u, after a).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
#: (state, initial) -> state
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}

#: Symbols: s, u, a, o keepable rows by initial, upper case if truncated; x must be deleted.
MUST_DELETE = "x"
FIRST_RULE = 0xE000

NOT_BLANK = re.compile("[^\x20\x09-\x0d]")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


# ------------------------------------------------------------ min-plus algebra

class Rope:
    """Two strings or ropes in a row, unjoined."""

    __slots__ = ("length", "left", "right")

    def __init__(self, left, right):
        self.left, self.right, self.length = left, right, _length(left) + _length(right)


def _length(rope) -> int:
    return rope.length if isinstance(rope, Rope) else len(rope)


def join(left, right):
    """The concatenation; short strings are copied, longer ones linked."""
    if not _length(left):
        return right
    if not _length(right):
        return left
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= 24:
        return left + right
    return Rope(left, right)


def flat(rope) -> str:
    out, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, Rope):
            todo += (top.right, top.left)
        else:
            out.append(top)
    return "".join(out)


def before(a, b) -> bool:
    """Whether a is less than b in ASCII order; parts that both share are not looked into."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
        elif isinstance(x, Rope) and (isinstance(y, str) or x.length >= y.length):
            left += (x.right, x.left)
            right.append(y)
        else:
            left.append(x)
            right += (y.right, y.left)
    return not left and any(_length(r) for r in right)


def better(a, b):
    """The cheaper of two entries (cost, audit), of equal costs the one of the lesser audit."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def times(a, b):
    """The min-plus product of two matrices, or of rows and a matrix; None stands for no way."""
    out = []
    for row in a:
        line = []
        for q in STATES:
            best = None
            for m in STATES:
                x, y = row[m], b[m][q]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = better(best, (x[0] + y[0], join(x[1], y[1])))
            line.append(best)
        out.append(line)
    return out


IDENTITY = [[(0, "") if p == q else None for q in STATES] for p in STATES]


def _insertions():
    """The cheapest insertions from state to state."""
    step = [[better(IDENTITY[p][q], (INSERT, "I") if q in (MOVES.get((p, "u")), MOVES.get((p, "a"))) else None)
             for q in STATES] for p in STATES]
    return times(times(step, step), times(step, step))


INSERTIONS = _insertions()


@lru_cache(None)
def _symbol(symbol: str):
    """The matrix of one row: insertions before it, then what becomes of it."""
    step = [[None] * 4 for _ in STATES]
    kind, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for p in STATES:
        step[p][p] = better(step[p][p], (DELETE, "D"))
        if kind == MUST_DELETE:
            continue
        for initial in "ua":
            if (p, initial) in MOVES:
                q = MOVES[p, initial]
                step[p][q] = better(step[p][q], (REROLE + extra, "R"))
        if (p, kind) in MOVES:
            q = MOVES[p, kind]
            step[p][q] = better(step[p][q], (extra, "K"))
    return times(INSERTIONS, step)


class Grammar:
    """Rules (new symbol, left, right) in the order in which they were made."""

    def __init__(self, rules):
        self.rules, self._matrices = [tuple(r) for r in rules], None

    def __getstate__(self):
        return {"rules": self.rules, "_matrices": None}

    def compress(self, text: str) -> str:
        for name, left, right in self.rules:
            if left + right in text:
                text = text.replace(left + right, name)
        return text

    def matrix(self, symbol: str):
        if self._matrices is None:  # once per worker, bottom-up: a rule's halves are older than the rule
            self._matrices = {}
            for name, left, right in self.rules:
                self._matrices[name] = times(self.matrix(left), self.matrix(right))
        return self._matrices[symbol] if symbol in self._matrices else _symbol(symbol)

    def product(self, text: str, rows=IDENTITY):
        out = rows
        for symbol in self.compress(text):
            out = times(out, self.matrix(symbol))
        return out


def finish(row) -> tuple[int, str]:
    """Cost and audit of the best way from the start that ends well; ``row`` holds the ways to each state."""
    ends = times([row], INSERTIONS)[0]
    cost, audit = better(ends[START], ends[ASSISTANT])
    return cost, flat(audit)


# ---------------------------------------------------------------------- rows

def symbols(roles, texts, late=()) -> tuple[str, dict]:
    """Symbols and counts of the rows; ``late`` are places of rows seen in an earlier chunk."""
    out, seen, late = [], set(), set(late)
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for k, (role, text) in enumerate(zip(roles, texts)):
        again = k in late or (role, text) in seen
        seen.add((role, text))
        if not NOT_BLANK.search(text):
            count["blank"] += 1
            out.append(MUST_DELETE)
        elif again:
            count["duplicate"] += 1
            out.append(MUST_DELETE)
        else:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if text.rstrip(SPACES)[-1] not in ".!?":
                count["truncated"] += 1
                kind = kind.upper()
            out.append(kind)
    return "".join(out), count


def turn_facts(turns) -> tuple:
    """Least, greatest and number of distinct turns of rows sorted by turn, nulls left out."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def has_system(audit: str) -> bool:
    """Whether the repaired conversation opens with a system row: the pairs after it are even in number."""
    return (len(audit) - audit.count("D")) % 2 == 1


def repaired(roles, texts, audit: str, system: bool, emitted: int = 0) -> list[str]:
    """The rows that the edits leave, as ``role:text``; ``emitted`` rows went before."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = "user" if (emitted - system) % 2 == 0 else "assistant"
        if edit == "I":
            out.append(f"{role}:")
        else:
            out.append(f"{roles[at] if edit == 'K' else role}:{texts[at]}")
            at += 1
        emitted += 1
    return out


def cut_audit(audit: str, sizes):
    """Per chunk of ``sizes`` rows its part of the audit and the number of rows emitted before it."""
    at, emitted, last = 0, 0, len(sizes) - 1
    for k, size in enumerate(sizes):
        start, rows = at, 0
        while at < len(audit) and (rows < size or k == last):
            rows += audit[at] != "I"
            at += 1
        yield audit[start:at], emitted
        emitted += at - start - audit.count("D", start, at)


# -------------------------------------------------------------------- chunks

def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The damaged rows (conv, turn, role, text, gone): by crc32 of ``conv:turn`` modulo 20 a row is 0 dropped,
    1 emptied, 2 stripped of ``.!?``, 3 repeated, 4 made the user's.  A dropped row stays as a mark of its conversation."""
    col = lambda c: F.col(f"`{c}`")
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    out = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text)))
    return (rows.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), kind.alias("kind"),
                        F.when(kind == 4, "user").otherwise(blank(role)).alias("role"), out.alias("text"))
                .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
                .withColumn("gone", F.col("kind") == 0)
                .select("conv", F.when(~F.col("gone"), F.col("turn")).alias("turn"),
                        F.when(~F.col("gone"), F.col("role")).alias("role"),
                        F.when(~F.col("gone"), F.col("text")).alias("text"), "gone"))


CHUNK_FIELDS = "chunk long, whole boolean, turns array<long>, roles array<string>, texts array<string>, seq string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names))


def _chunks(rows: DataFrame) -> DataFrame:
    """Sorted rows as chunks; ``whole`` ones surely hold all of their conversation and know their symbols."""
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, {CHUNK_FIELDS}"
    schema = _schema(ddl)

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        conv, held, size, first, cut = None, None, 0, True, False

        def close(whole):
            nonlocal number, held, size
            turns, roles, texts = ([r[k] for r in held] for k in range(3))
            row = (conv, number, whole, turns, roles, texts, symbols(roles, texts)[0] if whole else None)
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            out = []
            for key, turn, role, text, gone in _columns(batch, "conv", "turn", "role", "text", "gone"):
                if held is None or key != conv:
                    if held is not None:
                        out.append(close(not first and not cut))
                        first = False
                    conv, held, size, cut = key, [], 0, False
                if gone:
                    continue
                more = len(role) + len(text)
                if held and (len(held) >= CHUNK_ROWS or size + more > CHUNK_BYTES):
                    out.append(close(False))
                    cut = True
                held.append((turn, role, text))
                size += more
            if out:
                yield _batch(out, schema)
        if held is not None:
            yield _batch([close(False)], schema)  # it may go on in the next partition

    return rows.mapInArrow(run, ddl)


# ------------------------------------------------------------------- grammar

def repair_grammar(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_A_ROUND,
                   least: int = LEAST_COUNT) -> Grammar:
    """Re-Pair over strings (seq, n), n the number of times that each occurs.

    Every round takes the most frequent pairs that share no symbol, so their
    replacements do not touch; pairs seen less than ``least`` times give no rule.
    """
    rules: list[tuple[str, str, str]] = []
    for _ in range(rounds):
        grammar = Grammar(rules)

        def count(batches, grammar=grammar):
            total = Counter()
            for batch in batches:
                for seq, n in zip(batch.column("seq").to_pylist(), batch.column("n").to_pylist()):
                    seq = grammar.compress(seq)
                    for pair in zip(seq, seq[1:]):
                        total[pair] += n
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] + p[1] for p in total]), pa.array(list(total.values()), pa.int64())],
                    names=["pair", "n"])

        best = (sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                         .filter(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(4 * per_round).collect())
        used, chosen = set(), []
        for pair, _n in best:
            if len(chosen) < per_round and not used & set(pair):
                chosen.append((chr(FIRST_RULE + len(rules) + len(chosen)), pair[0], pair[1]))
                used |= set(pair)
        if not chosen:
            break
        rules += chosen
    return Grammar(rules)


# ----------------------------------------------------------------- summaries

FACT_FIELDS = ("chunk long, rows long, seq string, blank long, duplicate long, truncated long, illegal long, head string, "
               "tail string, low long, high long, turns_seen long")
SUMMARY_FIELDS = ("ord long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, "
                  "high long, turns_seen long, costs array<long>, audits array<string>, chunks array<long>, sizes array<long>")
RESULT_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def facts(chunk: int, turns, roles, texts, late) -> dict:
    """Symbols and counts of one chunk."""
    seq, count = symbols(roles, texts, late)
    initials = [r[:1] for r in roles]
    low, high, seen = turn_facts(turns)
    return {"chunk": chunk, "rows": len(roles), "seq": seq, **count,
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
            "low": low, "high": high, "turns_seen": seen}


def summarise(fact: dict, grammar: Grammar) -> dict:
    """What the combination of chunks needs of one chunk."""
    out = {k: v for k, v in fact.items() if k not in ("chunk", "rows", "seq")}
    entries = [e for line in grammar.product(fact["seq"]) for e in line]
    return out | {"costs": [e and e[0] for e in entries], "audits": [e and flat(e[1]) for e in entries],
                  "chunks": [fact["chunk"]], "sizes": [fact["rows"]]}


def matrix_of(summary: dict):
    entries = [None if c is None else (c, a) for c, a in zip(summary["costs"], summary["audits"])]
    return [entries[4 * p:4 * p + 4] for p in STATES]


def combine(parts: list[dict]) -> dict:
    """The summary of consecutive parts (in the order of ``ord``)."""
    parts = sorted(parts, key=lambda s: s["ord"])
    out, matrix = dict(parts[0]), matrix_of(parts[0])
    for s in parts[1:]:
        for name in ("blank", "duplicate", "truncated"):
            out[name] += s[name]
        meet = out["tail"] is not None and s["head"] is not None
        out["illegal"] += s["illegal"] + int(meet and out["tail"] + s["head"] not in LEGAL)
        out["turns_seen"] += s["turns_seen"] - int(out["high"] is not None and out["high"] == s["low"])
        out["low"] = s["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if s["high"] is None else s["high"]
        out["head"] = s["head"] if out["head"] is None else out["head"]
        out["tail"] = out["tail"] if s["tail"] is None else s["tail"]
        out["chunks"], out["sizes"] = out["chunks"] + s["chunks"], out["sizes"] + s["sizes"]
        matrix = times(matrix, matrix_of(s))
    entries = [e for line in matrix for e in line]
    return out | {"costs": [e and e[0] for e in entries], "audits": [e and flat(e[1]) for e in entries]}


def _gaps(low, high, seen) -> int:
    return 0 if low is None else min(high - low + 1 - seen, (1 << 63) - 1)


# ------------------------------------------------------------------ operator

def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, gone): conv, the counts, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "conversations")
    conv = rows.schema["conv"].dataType.simpleString()
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # deals equal rows out
    keys: list[Column] = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)),
                          F.left("text", F.lit(64)), F.xxhash64("role", "text"), F.col("_salt")]
    ordered = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    chunks = scratch.keep(_chunks(ordered.select("conv", "turn", "role", "text", "gone")), "chunks")
    whole, parts = chunks.filter("whole"), chunks.filter("NOT whole")
    known = scratch.keep(_facts(parts, conv), "facts")
    sequences = scratch.keep(whole.select("seq").union(known.select("seq")).groupBy("seq").agg(F.count("*").alias("n")),
                             "sequences")
    grammar = repair_grammar(sequences)
    out = scratch.keep(_finish_whole(whole, grammar, conv).unionByName(_finish_parts(parts, known, grammar, conv, scratch)),
                       "repaired")
    scratch.drop("chunks", "facts", "sequences", "results")
    return out


def _facts(parts: DataFrame, conv: str) -> DataFrame:
    """Symbols and counts of chunks whose conversation may have more: a row seen in an earlier chunk is a duplicate."""
    def digests(batches):
        for batch in batches:
            out = []
            for key, chunk, roles, texts in _columns(batch, "conv", "chunk", "roles", "texts"):
                seen = set()
                for k, row in enumerate(zip(roles, texts)):
                    if row not in seen:
                        seen.add(row)
                        named = f"{key!r}:{len(row[0])}:{row[0]}{row[1]}".encode("utf-8", "surrogatepass")
                        out.append((hashlib.sha256(named).digest(), chunk, k))
            if out:
                yield _batch(out, digest_schema)

    def run(batches):
        for batch in batches:
            out = []
            for key, chunk, turns, roles, texts, late in _columns(batch, "conv", "chunk", "turns", "roles", "texts", "late"):
                out.append((key, *facts(chunk, turns, roles, texts, late or ()).values()))
            if out:
                yield _batch(out, schema)

    digest_schema, schema = _schema("digest binary, chunk long, place int"), _schema(f"conv {conv}, {FACT_FIELDS}")
    each = parts.select("conv", "chunk", "roles", "texts").mapInArrow(digests, "digest binary, chunk long, place int")
    first = each.groupBy("digest").agg(F.min("chunk").alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = (each.join(first, "digest").filter("chunk > first")
                .groupBy("chunk").agg(F.collect_list("place").alias("late")))  # at most CHUNK_ROWS
    return parts.join(late, "chunk", "left").mapInArrow(run, f"conv {conv}, {FACT_FIELDS}")


def _finish_whole(whole: DataFrame, grammar: Grammar, conv: str) -> DataFrame:
    """Results of the conversations that lie in one chunk."""
    ddl = f"conv {conv}, {RESULT_FIELDS}, repaired_sha256 string"
    schema = _schema(ddl)

    def run(batches):
        for batch in batches:
            out = []
            for key, turns, roles, texts, seq in _columns(batch, "conv", "turns", "roles", "texts", "seq"):
                known = facts(0, turns, roles, texts, ())
                cost, audit = finish(grammar.product(seq, IDENTITY[:1])[0])
                text = "\n".join(repaired(roles, texts, audit, has_system(audit)))
                out.append((key, _gaps(known["low"], known["high"], known["turns_seen"]), known["blank"], known["duplicate"],
                            known["truncated"], known["illegal"], cost, audit,
                            hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                yield _batch(out, schema)

    return whole.mapInArrow(run, ddl)


def _finish_parts(parts: DataFrame, known: DataFrame, grammar: Grammar, conv: str, scratch: Scratch) -> DataFrame:
    """Results of the conversations whose chunks must be combined."""
    ddl = f"conv {conv}, {SUMMARY_FIELDS}"
    schema, names = _schema(ddl), [f.split()[0] for f in SUMMARY_FIELDS.split(", ")]

    def first(batches):
        for batch in batches:
            out = [(r["conv"], *((summarise({k: r[k] for k in fact_names}, grammar) | {"ord": r["ord"]})[n] for n in names))
                   for r in batch.to_pylist()]
            if out:
                yield _batch(out, schema)

    def merge(batches):
        for batch in batches:
            out = [(r["conv"], *(combine(r["parts"])[n] for n in names)) for r in batch.to_pylist()]
            if out:
                yield _batch(out, schema)

    def results(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = finish(matrix_of(r)[START])
                out.append((r["conv"], _gaps(r["low"], r["high"], r["turns_seen"]), r["blank"], r["duplicate"],
                            r["truncated"], r["illegal"], cost, audit, r["chunks"], r["sizes"], r["chunks"][0]))
            if out:
                yield _batch(out, result_schema)

    def cuts(batches):
        for batch in batches:
            for lead, audit, chunks, sizes in _columns(batch, "lead", "audit", "chunks", "sizes"):
                system, done = has_system(audit), cut_audit(audit, sizes)
                yield _batch([(lead, chunk, *part, system) for chunk, part in zip(chunks, done)], cut_schema)

    def mend(batches):
        for batch in batches:
            out = []
            for lead, chunk, roles, texts, part, emitted, system in _columns(
                    batch, "lead", "chunk", "roles", "texts", "part", "emitted", "system"):
                lines = repaired(roles, texts, part, system, emitted)
                out.append((lead, chunk, "\n".join(lines) if lines else None))
            if out:
                yield _batch(out, mend_schema)

    def digest(batches):
        lead, sha, begun = None, None, False
        for batch in batches:
            out = []
            for key, text in _columns(batch, "lead", "text"):
                if key != lead:
                    if lead is not None:
                        out.append((lead, sha.hexdigest()))
                    lead, sha, begun = key, hashlib.sha256(), False
                if text is not None:
                    sha.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
                    begun = True
            if out:
                yield _batch(out, hash_schema)
        if lead is not None:
            yield _batch([(lead, sha.hexdigest())], hash_schema)

    fact_names = [f.split()[0] for f in FACT_FIELDS.split(", ")]
    result_ddl = f"conv {conv}, {RESULT_FIELDS}, chunks array<long>, sizes array<long>, lead long"
    cut_ddl, mend_ddl = "lead long, chunk long, part string, emitted long, system boolean", "lead long, chunk long, text string"
    hash_ddl = "lead long, repaired_sha256 string"
    result_schema, cut_schema, mend_schema, hash_schema = map(_schema, (result_ddl, cut_ddl, mend_ddl, hash_ddl))

    # the chunks of a conversation are numbered (one slim row to a chunk) and combined 2 ** FAN_IN_BITS at a time
    in_order = Window.partitionBy("conv").orderBy("chunk")
    placed = known.select("chunk", (F.row_number().over(in_order) - 1).cast("long").alias("ord"))
    level = 0
    now = scratch.keep(known.join(placed, "chunk").mapInArrow(first, ddl), "level-0")
    most = now.agg(F.max("ord")).first()[0] or 0
    while most >> (FAN_IN_BITS * level):
        level += 1
        group = now.groupBy("conv", F.shiftright("ord", FAN_IN_BITS * level).alias("_group"))
        merged = group.agg(F.collect_list(F.struct(*names)).alias("parts")).mapInArrow(merge, ddl)
        now = scratch.keep(merged, f"level-{level}")
        scratch.drop(f"level-{level - 1}")

    done = scratch.keep(now.mapInArrow(results, result_ddl), "results")
    scratch.drop(f"level-{level}")
    pieces = done.select("lead", "audit", "chunks", "sizes").mapInArrow(cuts, cut_ddl)
    mended = parts.select("chunk", "roles", "texts").join(pieces, "chunk").mapInArrow(mend, mend_ddl)
    hashes = mended.repartition("lead").sortWithinPartitions("lead", "chunk").mapInArrow(digest, hash_ddl)
    return done.join(hashes, "lead").select("conv", *[f.split()[0] for f in RESULT_FIELDS.split(", ")], "repaired_sha256")
