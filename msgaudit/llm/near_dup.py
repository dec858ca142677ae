"""Near-dedup by Order MinHash, verified by banded alignment.

Words are runs of anything but ASCII blanks, A-Z lower-cased.  Every k-mer of a
text's words is labelled with its occurrence (first, second, ... of equal
k-mers); each band's hash function samples the 2 smallest labelled k-mers,
which, in the order in which they stand in the text, are the key of the band.

* Texts of ``LONG_WORDS`` = 64 words or more have k-mers of three words and
  ``LONG_BANDS`` bands, so a frequent pair of words alone makes no collision.
  Pairs at likeness 0.8 share a key with a chance of 0.95 in the worst case
  (every edit spoils three k-mers), 0.99 with edits at random.
* Shorter ones have k-mers of two words and as many bands as give 0.999 in the
  worst case from ``SURE_WORDS`` = 20 words on (see :func:`tune`).  Texts from
  0.8 * 64 words on have both kinds of keys, so lengths on both sides of the
  border meet.
* Texts of at most ``FEW_WORDS`` = 14 words have a key for every way to leave
  out as many words as the alignment may change (two at most).  Any two of them
  that are like share what is left, so none is missed.

Texts of the same words in another order agree in fewer bands.

Texts that collide are verified by alignment: the edit distance of the two word
sequences in a band around the diagonal, widened step by step up to the largest
distance that 0.8 allows.  The likeness is 1 - distance / words of the longer
text.  Linked texts form classes (components); texts of equal word sequences
are one item from the start, so copies cost one row each.

Null and empty texts have no words and form one class.  Texts of fewer than
five words are like longer ones of five and their own copies.  Null
ids are larger than all others; the row with the smallest id of a class stays.
Repeated rows are copies.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh
from .common import Scratch, bound_batches, deal_out, hash_bitmap, in_bitmap, row_keys
from .exact_dedup import normalise

#: Words of a k-mer of the sketches, of shorter texts and of longer ones: an edit spoils at most so many k-mers.
SHORT_K, LONG_K = 2, 3
#: Texts of so many words have the longer k-mers; texts of at most so many are compared with words left out.
LONG_WORDS, FEW_WORDS = 64, 14
LEAST = 0.8
#: Chances with which two texts at LEAST share a key: from SURE_WORDS and from LONG_WORDS words on.
RECALL, SURE_WORDS, LONG_RECALL = 0.999, 20, 0.95
SEED = 7


def agreement(n: int, k: int, least: float = LEAST) -> float:
    """The least chance that texts at ``least``, the longer of n words, agree in one band.

    Every edit is a changed word and spoils k k-mers of either text, the worst
    case; both picked k-mers must be among those in common.
    """
    size = n - k + 1
    common = max(size - k * int((1 - least) * n + 1e-9), 0)
    union = 2 * size - common
    return common * (common - 1) / (union * (union - 1))


def tune(sizes, k: int, recall: float) -> int:
    """Bands with which texts of any of these sizes at LEAST share a key with the chance ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - min(agreement(n, k) for n in sizes))))


SHORT_BANDS = tune([SURE_WORDS], SHORT_K, RECALL)
LONG_BANDS = tune(range(LONG_WORDS, 4000), LONG_K, LONG_RECALL)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """32-bit hashes of words, remembered between texts."""

    LIMIT = 400_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF
        return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


def kmers(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit k-mers of concatenated texts, the text each belongs to and its first word's place.

    Texts shorter than k words have none.
    """
    if len(words) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.append(starts[1:], len(words))
    code = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        code = _mix(code + words[j:len(words) - k + 1 + j].astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(starts)), ends - starts)[:len(code)]
    place = np.flatnonzero(np.arange(len(code)) + k <= ends[owner])
    return code[place], owner[place], place


def labelled_kmers(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of concatenated texts, and where each text's begin."""
    code, owner, _ = kmers(words, starts, k)
    # the label: how many equal k-mers of the same text stand before
    own = _mix(code ^ _mix(owner.astype(np.uint64) + np.uint64(SEED)))
    order = np.argsort(own, kind="stable")
    new = np.r_[True, own[order][1:] != own[order][:-1]]
    run = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    label = np.empty(len(own), np.uint64)
    label[order] = (np.arange(len(own)) - run).astype(np.uint64)
    return _mix(code + label * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(owner, np.arange(len(starts)))


#: K-mers that are ranked at once: the arrays of a band then stay in the processor's cache.
AT_ONCE = 1 << 15


def order_minhash(kmers: np.ndarray, starts: np.ndarray, bands: int, seed: int = SEED) -> np.ndarray:
    """One key per text and band; texts with fewer than two k-mers must be left out."""
    seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(1000003) + np.uint64(seed))
    keys = np.empty((len(starts), bands), np.uint64)
    t = 0
    while t < len(starts):
        end = max(t + 1, int(np.searchsorted(starts, starts[t] + AT_ONCE)))
        some = kmers[starts[t]:starts[end] if end < len(starts) else len(kmers)]
        _rank(some, starts[t:end] - starts[t], seeds, keys[t:end])
        t = end
    return keys.view(np.int64)


def _rank(kmers: np.ndarray, starts: np.ndarray, seeds: np.ndarray, keys: np.ndarray) -> None:
    """Fills in the keys of the texts: their two smallest k-mers in each band, in the text's order."""
    low = np.arange(len(kmers), dtype=np.uint64)  # a batch holds far fewer than 2**32 k-mers
    high = np.uint64(0xFFFFFFFF00000000)
    ranked, spare = np.empty_like(kmers), np.empty_like(kmers)
    for b, s in enumerate(seeds):
        np.bitwise_xor(kmers, s, out=ranked)  # ranked = _mix(kmers ^ s) in place
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            np.right_shift(ranked, np.uint64(shift), out=spare)
            np.bitwise_xor(ranked, spare, out=ranked)
            if factor:
                np.multiply(ranked, np.uint64(factor), out=ranked)
        np.bitwise_and(ranked, high, out=ranked)
        np.bitwise_or(ranked, low, out=ranked)
        first = (np.minimum.reduceat(ranked, starts) & ~high).astype(np.int64)
        ranked[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = (np.minimum.reduceat(ranked, starts) & ~high).astype(np.int64)
        left, right = np.minimum(first, second), np.maximum(first, second)  # their order in the text
        keys[:, b] = _mix(kmers[left] * np.uint64(3) + _mix(kmers[right]) + s)  # the band is part of its key


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences, or most + 1 if it is larger.

    Alignment in a band of 2 w + 1 diagonals, w = 16, 64, ... up to ``most``;
    the columns' differences are kept as the bits of integers.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n:][::-1] == b[len(b) - n:][::-1]
    tail = n if same.all() else int(same.argmin())
    x, y = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if abs(len(x) - len(y)) > most:
        return most + 1
    if not x or not y:
        return max(len(x), len(y))
    cells = np.minimum(np.bincount(a[:len(x)] & 4095, minlength=4096), np.bincount(b[:len(y)] & 4095, minlength=4096))
    if max(len(x), len(y)) - int(cells.sum()) > most:  # words that share a cell count as equal, so this is no exact bound yet
        return most + 1
    common = sum((Counter(x) & Counter(y)).values())
    if max(len(x), len(y)) - common > most:
        return most + 1
    at: dict[int, list[int]] = {}
    for i, w in enumerate(x, 1):
        at.setdefault(w, []).append(i)
    width = min(most, 16)
    while True:
        if abs(len(x) - len(y)) <= width and (d := _in_band(len(x), y, at, width)) <= width:
            return d
        if width == most:
            return most + 1
        width = min(most, width * 4)


def _in_band(m: int, y: list[int], at: dict[int, list[int]], w: int) -> int:
    """Cost of the best alignment that stays within w of the diagonal.

    Bit i - j + w of a column's integers stands for row i; rows up to 0 cost
    what a path around them would, as do the rows that enter the band.
    """
    full, top = (1 << (2 * w + 1)) - 1, 1 << (2 * w)
    up = full ^ ((1 << (w + 1)) - 1)   # rows that cost one more than the row above
    down = (1 << (w + 1)) - 1          # rows that cost one less
    cost = w                           # of the band's last row
    for j, word in enumerate(y, 1):
        up, down = (up >> 1) | top, down >> 1
        match = 0
        rows = at.get(word)
        if rows is not None:
            lo = j - w
            for k in range(bisect_left(rows, lo), len(rows)):
                shift = rows[k] - lo
                if shift > 2 * w:
                    break
                match |= 1 << shift
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full ^ ((diagonal | up) & full))
        left = diagonal & up
        right = ((right << 1) | 1) & full
        left = (left << 1) & full
        up, down = left | (full ^ (diagonal | right)), diagonal & right
        cost += not diagonal & top
    row = m - len(y) + w
    return cost - (up >> (row + 1)).bit_count() + (down >> (row + 1)).bit_count()


def likeness(a: bytes, b: bytes, least: float = LEAST) -> float:
    """1 - distance / longer length of two packed word sequences; 0 below ``least``."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    n = max(len(x), len(y))
    most = int((1 - least) * n + 1e-9)
    d = edit_distance(x, y, most)
    return 0.0 if d > most else 1 - d / max(n, 1)


def _texts(batch, hasher):
    """Digests and concatenated word hashes of the batch's texts."""
    texts = [normalise(t).split() for t in batch.column("text").to_pylist()]
    digests = np.array([xxhash.xxh3_64_intdigest(b" ".join(t)) for t in texts], np.uint64).view(np.int64)
    return texts, digests


def edits(n: int, least: float = LEAST) -> int:
    """Edits that a likeness of ``least`` allows where the longer text has n words."""
    return int((1 - least) * n + 1e-9)


def left_out_keys(words: np.ndarray) -> list[int]:
    """Keys of a short text: all that remains when up to ``edits`` words are left out."""
    n, out = len(words), set()
    for gone in range(edits(n) + 1):
        for at in combinations(range(n), gone):
            out.add(xxhash.xxh3_64_intdigest(np.delete(words, at).tobytes(), SEED) - (1 << 63))
    return sorted(out)


def sketch_keys(words: list[np.ndarray]) -> list[list[int]]:
    """The keys of each of the word sequences."""
    keys: list[list[int]] = [left_out_keys(w) if 0 < len(w) <= FEW_WORDS else [] for w in words]
    shared = LEAST * FEW_WORDS  # shorter ones are like none of more than FEW_WORDS words
    for k, bands, low, high in ((SHORT_K, SHORT_BANDS, shared, LONG_WORDS), (LONG_K, LONG_BANDS, LEAST * LONG_WORDS, np.inf)):
        which = [i for i, w in enumerate(words) if low <= len(w) < high]
        if which:
            starts = np.cumsum([0] + [len(words[i]) for i in which])[:-1]
            found = order_minhash(*labelled_kmers(np.concatenate([words[i] for i in which]), starts, k), bands, SEED + k)
            for i, row in zip(which, found.tolist()):
                keys[i] = keys[i] + row
    return keys


def _sketch(batches):
    hasher = WordHasher()
    for batch in batches:
        texts, digests = _texts(batch, hasher)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "_k1": batch.column("_k1"), "_k2": batch.column("_k2"),
                                          "digest": pa.array(digests), "size": pa.array([len(t) for t in texts], pa.int32()),
                                          "keys": pa.array(sketch_keys([hasher(t) for t in texts]), pa.list_(pa.int64()))})


def _payload(wanted):
    """Word sequences of the digests in the bitmap, each once per task."""
    def run(batches):
        hasher, sent = WordHasher(), set()
        for batch in batches:
            texts, digests = _texts(batch, hasher)
            ids, data = [], []
            for i in np.flatnonzero(in_bitmap(wanted.value, digests)):
                if (d := int(digests[i])) not in sent:
                    sent.add(d)
                    ids.append(d)
                    data.append(hasher(texts[i]).tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "data": pa.array(data, pa.binary())})
    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, class_size, n_links, kept (and the row's keys).

    ``class_id`` is the smallest id of its class, ``n_links`` the number of
    verified links that built the class and end at the row's word sequence: in a
    large group it is fewer than the sequences that it is like, as pairs that
    are in one class already are not verified.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    sketches = scratch.keep(
        docs.select(doc_id.alias("id"), text.alias("text"), *row_keys(doc_id, text))
            .mapInArrow(_sketch, "id long, _k1 long, _k2 long, digest long, size int, keys array<long>"), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_k1", "_k2")
    items = scratch.keep(sketches.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.min(order).alias("low"),
                                                        F.count("*").alias("copies")), "items")
    keyed = items.select(F.col("digest").alias("id"), "keys", "size")
    members = scratch.keep(lsh.buckets(keyed, scratch), "members")
    scratch.drop("shared-keys")
    wanted = spark.sparkContext.broadcast(hash_bitmap(members.select("id").distinct(), "id"))
    payload = scratch.keep_by(docs.select(text.alias("text")).mapInArrow(_payload(wanted), "id long, data binary")
                                  .groupBy("id").agg(F.first("data").alias("data")), "payload", "id")
    found, roots = lsh.links(keyed, members, payload, likeness, LEAST, scratch)
    scratch.drop("payload", "members")
    ends = found.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    classed = (items.join(roots.withColumnRenamed("id", "digest"), "digest", "left").join(ends, "digest", "left")
                    .select("digest", "low", "copies", F.coalesce("root", "digest").alias("root"),
                            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    classes = classed.groupBy("root").agg(F.min("low").alias("first"), F.sum("copies").alias("class_size"))
    per_text = scratch.keep(classed.join(classes, "root").select("digest", "first", "class_size", "n_links"), "classes")
    return (sketches.drop("keys", "size").join(per_text, "digest")
                    .select("id", F.col("first.id").alias("class_id"), "class_size", "n_links",
                            F.struct(F.col("id").isNull(), "id", "_k1", "_k2").eqNullSafe(F.col("first")).alias("kept"),
                            "_k1", "_k2"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    kept = (near_dedup(docs, id_col, text_col).filter("kept").groupBy("_k1", "_k2")
            .agg(F.lit(1).cast("long").alias("copies"), F.count("*").alias("rows")))
    return deal_out(docs, [F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")], kept)
