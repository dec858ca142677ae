"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Every document becomes its token ids and one end id; only documents longer
than the capacity are cut, into pieces of the capacity and a rest.  Packing is
bulk-synchronous best-fit, longest pieces first:

* the pieces are range-sorted by length over the whole table, so that pieces
  of one length hold an interval of ranks (a run), and so do the sequences with
  the same gap;
* a sweep matches the longest unplaced run with its successor, the smallest
  gap that it fits; ranks decide which pieces and which gaps of the two runs
  meet, one to one; the gaps shrink, and the sweep goes on with what is left of
  the run; a run without a successor opens new sequences;
* this repeats until no run is left, and the intervals are then looked up for
  every piece where it lies.

Pieces of equal length are interchangeable, so matching runs gives exactly the
sequences that matching single pieces in this order would.  There are at most
as many runs of pieces as the capacity, whatever the input, hence the sweeps
run on the run table and pass no data; sorting and looking up are distributed.

Null texts count as empty and give the end id alone.  Repeated rows are packed
as often as they occur.  An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, global_index
from .exact_dedup import normalise

CAPACITY = 2048
END_ID = 0
#: Words whose ids a Python worker remembers before it starts anew.
CACHE_WORDS = 700_000

# Python splits at these four, the tokenizer doesn't count them as white space.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies (the path is a parameter everywhere)."""
    import public_tokenizers
    return public_tokenizers.path(name)


_STOPS = ".,;:!?"
#: Marks that a split as in ``_SPLIT`` parts from a letter or number before them; no elision and no special token has one.
_MARKS = "".join(sorted(set(punctuation) - set("'<|>")))
#: Words that are encoded as one text.
AT_ONCE = 64


def _leaves_letters(state: dict) -> bool:
    """Whether a tokenizer passes lower-case ASCII letters to its model in one part and as they are."""
    of = lambda part, name: [(s["type"], (s.get("pattern") or {}).get("Regex", "")) for s in (state.get(part) or {}).get(name, [])]
    normal, split = of("normalizer", "normalizers"), of("pre_tokenizer", "pretokenizers")
    return (normal == [("NFC", ""), ("Replace", r"\s+"), ("Lowercase", "")] and [t for t, _ in split] == ["Split", "ByteLevel"]
            and split[0][1] == _SPLIT and not state["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"])


#: A split that takes a run of letters as one part; the marks of elisions need an apostrophe.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Lower-case letters of ASCII and Latin-1 alone, which are their own normal form and one part of the text.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: The characters as which bytes reach the model behind a ByteLevel step; blanks stay and part words.
_KEPT = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
_MOVED = {c: 256 + k for k, c in enumerate(c for c in range(256) if c not in _KEPT)} | {32: 32}
_BYTES = "".join(chr(_MOVED.get(c, c)) for c in range(256))


def _as_bytes(line: str) -> str:
    """How plain words reach the model."""
    return line if line.isascii() else charmap_decode(line.encode(), "strict", _BYTES)[0]


class WordEncoder:
    """Token ids of texts for a tokenizer that lower-cases and drops white space.

    Such a tokenizer's normaliser and splitter never look across white space,
    so the ids of a text are those of its words one after the other; words
    recur, so their ids are remembered.  Nor do tokens reach from a letter or
    digit into the stops behind it, so a word with stops is its stem and them
    (any marks, where the splitter is known to part them).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        blank = AddedToken(" ", normalized=False, special=True)  # parts words before anything else looks at them
        self.words = Tokenizer.from_file(path)
        self.words.add_special_tokens([blank])
        self.plain, self.stops = None, _STOPS  # the bare model, where lower-case letters reach it as their bytes
        state = json.loads(self.tokenizer.to_str())
        if _leaves_letters(state):
            special = set().union(*(t["content"] for t in state["added_tokens"]))
            self.stops = "".join(c for c in _MARKS if c not in special)
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.add_special_tokens([blank])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words that leave unless they come again

    def _ids(self, words: list[str]) -> None:
        if self.plain is not None:
            plain = [w for w in words if _PLAIN(w)]
            self._ids_of(self.plain, plain, _as_bytes)
            if len(plain) == len(words):
                return
            words = [w for w in words if not _PLAIN(w)]
        self._ids_of(self.words, words)

    def _ids_of(self, tokenizer, words: list[str], shown=str) -> None:
        """Words go to the tokenizer many at a time, parted by blanks, whose ids part theirs again; a line as ``shown`` makes it."""
        blank, lines = tokenizer.token_to_id(" "), [words[k:k + AT_ONCE] for k in range(0, len(words), AT_ONCE)]
        for line, e in zip(lines, tokenizer.encode_batch_fast([shown(" ".join(x)) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts, raw = (np.flatnonzero(ids == blank) * 4).tolist(), ids.tobytes()
            for w, lo, hi in zip(line, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)]):
                self.known[w] = raw[lo:hi]

    def _learn(self, words: set[str]) -> None:
        """Makes the ids of all ``words`` known; half of the cache goes when it is full, words in use stay."""
        fresh = words.difference(self.known)
        if len(self.known) + 2 * len(fresh) > CACHE_WORDS // 2:
            self.known, self.older = {w: self.known[w] for w in words.intersection(self.known)}, self.known
        if self.older:
            again = fresh.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            fresh -= again
        whole, cut = set(), []
        for w in [w for w in fresh if w[-1] in self.stops]:
            stem = w.rstrip(self.stops)
            # the stem must end in a letter or digit in lower case too (a dotted capital I then ends in a mark)
            if stem and stem[-1].lower()[-1].isalnum():
                cut.append((w, stem, w[len(stem):]))
                whole.update((stem, w[len(stem):]))
                fresh.remove(w)
        whole = whole.difference(self.known)
        self.known.update((w, self.older[w]) for w in whole if w in self.older)
        fresh.update(w for w in whole if w not in self.older)
        self._ids(list(fresh))
        for w, stem, stops in cut:
            self.known[w] = self.known[stem] + self.known[stops]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = []
        for text in texts:
            if any(s in text for s in _SEPARATORS):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            # lower-casing A-Z first makes words recur more; it commutes with composing where nothing is left to compose
            low = text.lower() if text.isascii() else normalise(text).decode("utf-8", "surrogatepass")
            if low.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", low)):
                text = low
            out.append(text.split())
        self._learn(set().union(*(w for w in out if isinstance(w, list))))
        return [w if isinstance(w, bytes) else b"".join(map(self.known.__getitem__, w)) for w in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoders.setdefault(path, None) or WordEncoder(path)
        _encoders[path] = encoder
        for b in batches:
            out = []
            texts = [text or "" for text in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode_all(texts)):
                ids += end
                for k in range(0, len(ids), capacity * 4):
                    part = ids[k:k + capacity * 4]
                    out.append((doc, k // (capacity * 4), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def match_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """Best-fit of the runs {length: number}, longest first.

    Returns (first rank, first sequence, place) of each matched interval in
    rank order (ranks count pieces from the longest on), and the number of
    sequences.  An interval's k-th piece goes to its k-th sequence.
    """
    out: list[tuple[int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals (first sequence, number)
    sizes: list[int] = []                        # gaps that occur, ascending
    rank = opened = 0

    def put(gap, first, number):
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                now = min(left, number)
                if now < number:
                    put(gap, first + now, number - now)
            else:
                # no successor: the run fills whole new sequences, its rest starts one more
                fit = min(capacity // length, left)
                now = max(1, left // fit) if fit == capacity // length else 1
                first, opened = opened, opened + now
                for k in range(fit):
                    out.append((rank, first, k * length))
                    rank, left = rank + now, left - now
                put(capacity - fit * length, first, now)
                continue
            out.append((rank, first, capacity - gap))
            put(gap - length, first, now)
            rank, left = rank + now, left - now
    return out, opened


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    pieces = scratch.keep(rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id),
                                          "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most one row per length up to the capacity
    intervals, _ = match_runs(counts, capacity)
    table = spark.sparkContext.broadcast(np.array(intervals or [(0, 0, 0)], np.int64))
    ranked = global_index(pieces, [F.col("length").desc(), F.col("id"), F.col("piece"), F.col("ids_crc32")], scratch, "ranked")

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        first, sequence, offset = table.value.T
        at = np.searchsorted(first, rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    return (ranked.withColumn("_p", place("_idx"))
                  .select("id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset"))
