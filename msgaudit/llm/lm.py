"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored
as sorted hash arrays that workers memory-map.

Tokens: words (runs of anything but ASCII blanks, A-Z lower-cased) and one end
per text; the end also stands before the first word.

Training takes two passes over the training texts.  The first counts words by
64-bit hash; the counts are range-sorted by hash and written as arrays, and a
word's id is its rank.  The second counts pairs: a task sums its own pairs and
sends them as blocks to the part that owns their history (pairs of a history
with more than a part's share of all tokens are spread over the parts by pair),
a part merges its blocks, writes the sorted pair hashes with their counts and
sends what it knows of histories (tokens; words seen once, twice, more) and of
words (distinct histories) to the owners of these ids, which add it up into
arrays by id.  Only the parts' sizes and the counts of counts reach the driver.

Scoring looks tokens and pairs up in the mapped arrays, for every text:

    p(w|h) = max(c - D(c), 0) / C(h) + g(h) p(w)
    p(w)   = max(a - E(a), 0) / A + l / (V + 1)

with c the pair's count, C(h) the history's tokens, a the word's distinct
histories, A their sum, D and E the modified discounts for 1, 2 and 3 or more,
g and l what the discounts leave over.  After an unseen history p(w) is used;
an unseen word has l / (V + 1).

Null and empty texts are one end token.  Null ids take part like the empty id.
Repeated rows count as often as they occur.  Without training texts every
probability is 1.  Bigrams, since the pairs of a corpus of random words hardly
repeat: three-word counts would need more than the disk that is allowed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .exact_dedup import normalise
from .files import ArrayFiles

#: Rows with crc32(id) mod FOLDS equal to HELD_OUT are not trained on.
FOLDS, HELD_OUT = 7, 2
END = b" "  # no word holds a blank
#: Distinct words, and pairs, that a task holds before it sends them on.
FLUSH_WORDS = 400_000
FLUSH_PAIRS = 2_000_000
#: Training tokens of one part of the pair arrays.
PART_TOKENS = 3_000_000


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of ids."""
    return _scramble(_scramble(history.astype(np.uint64) + np.uint64(1)) * np.uint64(3) + word.astype(np.uint64))


def _narrow(a: np.ndarray) -> bytes:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 256 else "u2" if top < 65536 else "u4" if top < 1 << 32 else "u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, an order that sorts all, and where in it each distinct one begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[first], order, first


# ------------------------------------------------------------------ counting

def _count_words(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_pydict({"h": pa.array(word_hashes(counts)),
                                           "n": pa.array(list(counts.values()), pa.int64())})
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not held_out(doc):
                counts.update(normalise(text).split())
                counts[END] += 1
        if len(counts) > FLUSH_WORDS:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _write_words(files: ArrayFiles):
    """Sorted (hash, count) rows of a range as two arrays; one row about them."""
    def run(batches):
        part, hashes, counts = TaskContext.get().partitionId(), [], []
        for b in batches:
            hashes.append(b.column(0).to_numpy())
            counts.append(b.column(1).to_numpy())
        if sum(map(len, hashes)):
            h, n = np.concatenate(hashes), np.concatenate(counts)
            files.write(f"words-{part}", h)
            files.write(f"counts-{part}", n)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "words": pa.array([len(h)], pa.int64()),
                                              "tokens": pa.array([int(n.sum())], pa.int64()),
                                              "low": pa.array([int(h[0])], pa.int64())})
    return run


class Numbers(dict):
    """Numbers words 0, 1, 2, ... as they are looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Ids (ranks by hash) and counts of the training words."""

    def __init__(self, files: ArrayFiles, parts: list[tuple[int, int, int, int]]):
        self.files = files
        self.parts = [p for p, *_ in parts]
        self.low = np.array([low for *_, low in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum([n for _, n, *_ in parts])]).astype(np.int64)
        self.size, self.tokens = int(self.first[-1]), sum(t for _, _, t, _ in parts)
        self.forget()

    def forget(self) -> None:
        """Start the worker's own numbering of words anew."""
        self.known = Numbers()
        self.ids, self.epoch = np.empty(0, np.int64), getattr(self, "epoch", 0) + 1

    def __getstate__(self):
        return self.__dict__ | {"known": Numbers(), "ids": np.empty(0, np.int64)}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the hashes, -1 for unseen words."""
        out = np.full(len(hashes), -1, np.int64)
        owner = np.searchsorted(self.low, hashes, "right") - 1
        for k in np.unique(owner[owner >= 0]):
            mine = np.flatnonzero(owner == k)
            array = self.files.map(f"words-{self.parts[k]}", np.int64)
            at = np.minimum(np.searchsorted(array, hashes[mine]), len(array) - 1)
            hit = array[at] == hashes[mine]
            out[mine[hit]] = self.first[k] + at[hit]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        owner = np.where(ids < 0, -1, np.searchsorted(self.first, ids, "right") - 1)
        for k in np.unique(owner[owner >= 0]):
            mine = owner == k
            out[mine] = self.files.map(f"counts-{self.parts[k]}", np.int64)[ids[mine] - self.first[k]]
        return out

    def locate(self, tokens: list[bytes]) -> np.ndarray:
        """The worker's own numbers of the tokens; ``ids`` holds these words' ids (-1: unseen)."""
        if len(self.known) > FLUSH_WORDS:
            self.forget()
        out = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        if len(self.known) > len(self.ids):
            hashes = word_hashes(islice(self.known, len(self.ids), None))  # in the order of their numbers
            order = np.argsort(hashes)
            found = np.empty(len(hashes), np.int64)
            found[order] = self.find(hashes[order])
            self.ids = np.concatenate([self.ids, found])
        return out


def tokens_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all texts, each text's end included, and where each text starts."""
    tokens, starts = [], []
    for text in texts:
        starts.append(len(tokens))
        tokens += normalise(text).split()
        tokens.append(END)
    return tokens, np.array(starts, np.int64)


def _pairs(ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The history of every token: the one before, the end id at a text's start."""
    history = np.empty_like(ids)
    history[1:] = ids[:-1]
    history[starts] = end
    return history


class Parts:
    """Which part owns a pair: its history's, or by pair for heavy histories."""

    def __init__(self, number: int, heavy: np.ndarray):
        self.number, self.heavy = number, np.sort(heavy)

    def of(self, history: np.ndarray, keys: np.ndarray) -> np.ndarray:
        own = _scramble(history.astype(np.uint64)) % np.uint64(self.number)
        spread = np.isin(history, self.heavy)
        own[spread] = keys[spread] % np.uint64(self.number)
        return own.astype(np.int64)


_BLOCK = "kind string, part int, n long, ids binary, a binary, b binary, c binary, d binary"
_BLOCK_FIELDS = ["kind", "part", "n", "ids", "a", "b", "c", "d"]


def _count_pairs(words: Words, parts: Parts):
    def blocks(history, word):
        history, word = np.concatenate(history), np.concatenate(word)
        keys, order, first = _distinct(pair_keys(history, word))
        at, n = order[first], np.diff(np.append(first, len(order)))
        history, word = history[at], word[at]
        owner = parts.of(history, keys)
        order = np.argsort(owner, kind="stable")
        owners, cut = np.unique(owner[order], return_index=True)
        rows = [(int(p), len(i), _narrow(history[i]), _narrow(word[i]), _narrow(n[i]))
                for p, i in zip(owners, np.split(order, cut[1:]))]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[2:]],
            names=["part", "size", "h", "w", "n"])

    def run(batches):
        history, word, held = [], [], 0
        for b in batches:
            texts = [t for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not held_out(d)]
            if not texts:
                continue
            tokens, starts = tokens_of(texts)
            at = words.locate(tokens)
            ids = words.ids[at]
            history.append(_pairs(ids, starts, ids[-1]))
            word.append(ids)
            held += len(ids)
            if held >= FLUSH_PAIRS:
                yield blocks(history, word)
                history, word, held = [], [], 0
        if held:
            yield blocks(history, word)
    return run


def _merge_pairs(files: ArrayFiles, parts: int, span: int):
    """One part's blocks: its pair arrays, and blocks about histories and words."""
    def split(kind, ids, values):
        order = np.argsort(ids)
        ids, values = ids[order], [v[order] for v in values]
        owners, cut = np.unique(ids // span, return_index=True)
        for k, (owner, lo) in enumerate(zip(owners, cut)):
            hi = cut[k + 1] if k + 1 < len(cut) else len(ids)
            blobs = [_narrow(v[lo:hi]) for v in values]
            yield (kind, int(owner), int(hi - lo), _narrow(ids[lo:hi] - owner * span), *blobs, *[b""] * (4 - len(blobs)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        history, word, n = (np.concatenate([_wide(x, s) for x, s in zip(pdf[c], pdf["size"])]) for c in ("h", "w", "n"))
        keys, order, first = _distinct(pair_keys(history, word))
        total = np.add.reduceat(n[order], first)
        history, word = history[order[first]], word[order[first]]
        files.write(f"pairs-{part}", keys)
        wide = 4 if total.max() < 1 << 32 else 8
        files.write(f"pair-counts-{part}", total.astype(f"u{wide}"))
        rows = [("meta", part, wide, b"", *[int((total == c).sum()).to_bytes(8, "little") for c in (1, 2, 3, 4)])]
        h, inverse = np.unique(history, return_inverse=True)
        rows += split("history", h, [np.bincount(inverse, weights=total).astype(np.int64)]
                      + [np.bincount(inverse[total == c] if c < 3 else inverse[total >= 3], minlength=len(h))
                         for c in (1, 2, 3)])
        rows += split("word", *(lambda u: (u[0], [u[1]]))(np.unique(word, return_counts=True)))
        return pd.DataFrame(rows, columns=_BLOCK_FIELDS)
    return run


_BY_ID = ("tokens", "once", "twice", "more", "histories")


def _merge_ids(files: ArrayFiles, span: int):
    """Arrays by id of one range of ids, from the blocks of all parts."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        out = {name: np.zeros(span, np.int64) for name in _BY_ID}
        for kind, n, ids, *values in pdf[["kind", "n", "ids", "a", "b", "c", "d"]].itertuples(index=False):
            at = _wide(ids, n)
            for name, v in zip(_BY_ID[:4] if kind == "history" else _BY_ID[4:], values):
                out[name][at] += _wide(v, n)
        for name, v in out.items():
            files.write(f"{name}-{part}", v)
        seen = out["histories"]
        return pd.DataFrame([("ids", part, int(seen.sum()), b"", *[int((seen == c).sum()).to_bytes(8, "little")
                                                                  for c in (1, 2, 3, 4)])], columns=_BLOCK_FIELDS)
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2, and 3 or more."""
    out = np.zeros(4)
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            out[k] = min(max(k - (k + 1) * y * b / a, 0.0), k) if a else 0.0
    else:  # too little text for the estimate
        out[1:] = 0.5
    return out


class Model:
    """Scores texts from the arrays; small, so that tasks carry it."""

    def __init__(self, files, words, parts, span, meta, ids):
        self.files, self.words, self.parts, self.span = files, words, parts, span
        self._epoch, self._rows = -1, np.empty((4, 0))
        self.owners = {p: f"u{wide}" for p, wide, _ in meta}
        self.pair_discount = discounts(*np.sum([c for *_, c in meta], axis=0).tolist()) if meta else np.zeros(4)
        self.types = sum(n for n, _ in ids)
        counts = np.sum([c for _, c in ids], axis=0).tolist() if ids else [0] * 4
        self.word_discount = discounts(*counts)
        above = self.words.size - counts[0] - counts[1]
        left = self.word_discount[1] * counts[0] + self.word_discount[2] * counts[1] + self.word_discount[3] * above
        self.unseen = (left / self.types if self.types else 1.0) / (self.words.size + 1)

    def _by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        owner = np.where(ids < 0, -1, ids // self.span)
        for k in np.unique(owner[owner >= 0]):
            mine = owner == k
            out[mine] = self.files.map(f"{name}-{k}", np.int64)[ids[mine] - k * self.span]
        return out

    def _pair_counts(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word))
        known = np.flatnonzero((history >= 0) & (word >= 0))
        keys = pair_keys(history[known], word[known])
        owner = self.parts.of(history[known], keys)
        # sorted lookups walk through the arrays; the keys' upper bits will do for that
        bits = np.uint64(self.parts.number.bit_length())
        order = np.argsort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits))
        known, keys = known[order], keys[order]
        owners, cut = np.unique(owner[order], return_index=True)
        for p, lo, hi in zip(owners.tolist(), cut, np.append(cut[1:], len(keys))):
            if p not in self.owners:
                continue
            array = self.files.map(f"pairs-{p}", np.uint64)
            at = np.minimum(np.searchsorted(array, keys[lo:hi]), len(array) - 1)
            hit = array[at] == keys[lo:hi]
            out[known[lo:hi][hit]] = self.files.map(f"pair-counts-{p}", self.owners[p])[at[hit]]
        return out

    def _about(self) -> np.ndarray:
        """Per word that the worker knows: count, p(w), g(w), C(w)."""
        words, d = self.words, self.pair_discount
        if self._epoch != words.epoch:
            self._epoch, self._rows = words.epoch, np.empty((4, 0))
        ids = words.ids[self._rows.shape[1]:]
        if len(ids):
            seen = self._by_id("histories", ids)
            low = np.maximum(seen - self.word_discount[np.minimum(seen, 3).astype(int)], 0) / max(self.types, 1) + self.unseen
            tokens, once, twice, more = (self._by_id(n, ids) for n in _BY_ID[:4])
            left = np.where(tokens > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(tokens, 1), 1.0)
            self._rows = np.concatenate([self._rows, [words.counts(ids), low, left, tokens]], axis=1)
        return self._rows

    def probabilities(self, tokens: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the tokens, and p(token | history); the last token must be an end."""
        at = self.words.locate(tokens)
        counts, low, left, total = self._about()
        history, ids = _pairs(at, starts, at[-1]), self.words.ids
        c = self._pair_counts(ids[history], ids[at])
        high = np.maximum(c - self.pair_discount[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[history], 1)
        return counts[at], high + left[history] * low[at]

    def score_batches(self):
        def run(batches):
            words = self.words
            for b in batches:
                if not b.num_rows:
                    continue
                tokens, starts = tokens_of(b.column(1).to_pylist())
                counts, p = self.probabilities(tokens, starts)
                base = np.log10((counts + 1) / (words.tokens + words.size + 1))
                p = np.log10(p)
                sizes = np.diff(np.append(starts, len(tokens)))
                docs = b.column(0)
                yield pa.RecordBatch.from_pydict({
                    "id": docs, "held_out": pa.array([held_out(d) for d in docs.to_pylist()], pa.bool_()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    "train_tokens": pa.array([words.tokens] * len(sizes), pa.int64()),
                    "base_score": pa.array(np.add.reduceat(base, starts)),
                    "score": pa.array(np.add.reduceat(p, starts))})
        return run

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

        The perplexity of a text is ``10 ** (-score / n_tokens)``.
        """
        bound_batches(docs.sparkSession)
        return _slim(docs, id_col, text_col).mapInArrow(
            self.score_batches(), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")


def _slim(docs, id_col, text_col):
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count the texts that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "lm")
    files = ArrayFiles(scratch.path("arrays"))
    rows = _slim(docs, id_col, text_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    counts = scratch.keep(rows.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    written = (counts.repartitionByRange(partitions, "h").sortWithinPartitions("h")
                     .mapInArrow(_write_words(files), "part int, words long, tokens long, low long")).collect()
    words = Words(files, [tuple(r) for r in sorted(written, key=lambda r: r["low"])])  # one row per range
    number = max(partitions, -(-words.tokens // PART_TOKENS))
    share = max(words.tokens // number, 1)
    heavy = [r["h"] for r in counts.filter(F.col("n") > share).select("h").collect()]  # fewer than there are parts
    parts = Parts(number, words.find(np.array(heavy, np.int64)))
    scratch.drop("counts")

    span = max(1, -(-words.size // number))
    blocks = rows.mapInArrow(_count_pairs(words, parts), "part int, size long, h binary, w binary, n binary")
    merged = scratch.keep(blocks.groupBy("part").applyInPandas(_merge_pairs(files, number, span), _BLOCK), "merged")
    number_of = lambda r: [int.from_bytes(r[c], "little") for c in ("a", "b", "c", "d")]
    meta = merged.filter("kind = 'meta'").collect()     # one row per part
    ids = (merged.filter("kind <> 'meta'").groupBy("part")
                 .applyInPandas(_merge_ids(files, span), _BLOCK).collect())  # one row per range of ids
    scratch.drop("merged")
    return Model(files, words, parts, span,
                 [(r["part"], r["n"], number_of(r)) for r in meta], [(r["n"], number_of(r)) for r in ids])
