"""Substring dedup by paragraph MinHash banding.

A text's paragraphs are

* its lines of at least ``LINE_WORDS`` words, and
* aligned paragraphs: stretches of ``SPAN_WORDS`` words that start where the
  text itself says (the smallest hash of ``K`` words in every window of
  ``WINDOW`` such hashes), so that a passage copied into the middle of another
  line is cut in the same places there.  Any passage of at least WINDOW + K +
  SPAN_WORDS - 2 = 50 words that two texts share holds one whole aligned
  paragraph of both, whatever surrounds it.

Lines are compared by MinHash over shingles of K words in bands tuned for
recall (see :func:`tune`), colliding lines are joined, verified by the exact
Jaccard likeness of their shingle sets, and linked lines form components; equal
lines share a digest and are one line, wherever they stand.  An
aligned paragraph is one shingle, so equal digests decide it.  A class of
paragraphs found in at least two documents is a repeat: its first occurrence
(smallest id, then place) stays, the others are to be removed.

Scans are read twice: first only hashes are counted, and a bitmap of fixed size
of those that occur in two places lets the second scan send nothing but the
paragraphs that may repeat.  Words are runs of anything but ASCII blanks, A-Z
lower-cased.  Null and empty texts have no paragraphs.  A document is a row's id
and text together, so rows that share an id, or have none, are documents of
their own (null ids come first); rows equal in both are one.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lsh
from .common import Scratch, bound_batches, hash_bitmap, in_bitmap, row_keys
from .exact_dedup import normalise
from .near_dup import WordHasher, _mix, kmers

K = 5
LEAST = 0.8
#: Share of the pairs at LEAST that the bands must find.
RECALL = 0.999
LINE_WORDS, SPAN_WORDS, WINDOW = 25, 30, 17
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune(least: float = LEAST, recall: float = RECALL, most: int = 12) -> tuple[int, int]:
    """(bands, rows): the most selective bands, at most ``most``, that reach the recall."""
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - least ** rows)))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def minhash_bands(code: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per line and band, from the lines' shingles; every line has a shingle."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(7919))
    keys = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for s in seeds[b * rows:(b + 1) * rows]:
            key = _mix(key * np.uint64(31) + np.minimum.reduceat(_mix(code ^ s), starts))
        keys[:, b] = key
    return keys.view(np.int64)


def aligned(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and digests of the aligned paragraphs of concatenated texts."""
    code, owner, place = kmers(words, starts, K)
    if len(code) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(_mix(code), WINDOW)
    low = windows.argmin(axis=1) + np.arange(len(windows))
    low = low[owner[:len(windows)] == owner[WINDOW - 1:]]  # a window lies within one text
    low = np.unique(low)
    ends = np.append(starts[1:], len(words))
    at = place[low]
    at = at[at + SPAN_WORDS <= ends[owner[low]]]
    digest = np.full(len(at), SPAN_WORDS, np.uint64)
    for j in range(SPAN_WORDS):
        digest = _mix(digest * np.uint64(31) + words[at + j].astype(np.uint64))
    return at, digest.view(np.int64)


class Cutter:
    """Lines and aligned paragraphs of the texts of a batch."""

    def __init__(self):
        self.hasher = WordHasher()
        self.bands, self.rows = tune()

    def __call__(self, texts: list[str | None]):
        lines = [[line.split() for line in normalise(t).split(b"\n")] for t in texts]
        counts = [[len(w) for w in doc] for doc in lines]
        self.words = self.hasher([w for doc in lines for line in doc for w in line])
        self.doc_starts = np.cumsum([0] + [sum(c) for c in counts])[:-1]
        flat = np.array([n for c in counts for n in c], np.int64)
        line_starts = np.cumsum(flat) - flat
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        # \v, \f and \r are blanks within a line; only \n ends one
        long = np.flatnonzero(flat >= LINE_WORDS)
        self.line_doc, self.line_at, self.line_n = owner[long], line_starts[long], flat[long]
        if len(long):
            take = np.concatenate([np.arange(a, a + n) for a, n in zip(self.line_at, self.line_n)])
            starts = np.cumsum(self.line_n) - self.line_n
            code, line_of, _ = kmers(self.words[take], starts, K)
            self.cuts = np.searchsorted(line_of, np.arange(len(long)))
            self.shingles = code
            self.keys = minhash_bands(code, self.cuts, self.bands, self.rows)
            total = np.add.reduceat(_mix(code + _mix(np.arange(len(code), dtype=np.uint64)
                                                     - np.repeat(self.cuts, np.diff(np.append(self.cuts, len(code))))
                                                     .astype(np.uint64))), self.cuts)
            self.digests = _mix(total ^ self.line_n.astype(np.uint64)).view(np.int64)
        else:
            self.keys, self.digests = np.empty((0, self.bands), np.int64), np.empty(0, np.int64)
        self.span_at, self.span_digest = aligned(self.words, self.doc_starts) if len(self.words) else (
            np.empty(0, np.int64), np.empty(0, np.int64))
        self.span_doc = np.searchsorted(self.doc_starts, self.span_at, "right") - 1

    def shingle_set(self, line: int) -> bytes:
        end = self.cuts[line + 1] if line + 1 < len(self.cuts) else len(self.shingles)
        return np.unique(self.shingles[self.cuts[line]:end].astype(np.uint32)).tobytes()


def _hashes(batches):
    """First scan: digests of spans and lines with their document, band keys with their line."""
    cut = Cutter()
    for batch in batches:
        cut(batch.column("text").to_pylist())
        ids = batch.column("row").to_numpy()
        keys = np.concatenate([cut.span_digest, cut.digests, cut.keys.ravel()])
        vals = np.concatenate([ids[cut.span_doc], ids[cut.line_doc], np.repeat(cut.digests, cut.bands)])
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "val": pa.array(vals)})


_FOUND = "kind string, key long, row long, id long, start long, end long, keys array<long>, data binary"


def _found(repeated):
    """Second scan: the paragraphs whose hashes were seen in two places."""
    def run(batches):
        cut, sent = Cutter(), set()
        for batch in batches:
            texts, ids, row_of = (batch.column(c).to_pylist() for c in ("text", "id", "row"))
            cut(texts)
            spans = np.flatnonzero(in_bitmap(repeated.value, cut.span_digest))
            like = in_bitmap(repeated.value, cut.keys.ravel()).reshape(cut.keys.shape).any(axis=1)
            lines = np.flatnonzero(like | in_bitmap(repeated.value, cut.digests))
            places: dict[int, list] = {}
            rows = []

            def add(kind, key, doc, at, n):
                if doc not in places:
                    places[doc] = [m.span() for m in _WORD.finditer(texts[doc])]
                at -= int(cut.doc_starts[doc])
                rows.append((kind, key, row_of[doc], ids[doc], places[doc][at][0], places[doc][at + n - 1][1], None, None))

            for i in spans:
                add("span", int(cut.span_digest[i]), int(cut.span_doc[i]), int(cut.span_at[i]), SPAN_WORDS)
            for i in lines:
                digest = int(cut.digests[i])
                add("line", digest, int(cut.line_doc[i]), int(cut.line_at[i]), int(cut.line_n[i]))
                if like[i] and digest not in sent:  # a line that only recurs as it is has none to be compared with
                    sent.add(digest)
                    rows.append(("item", digest, None, None, None, None, cut.keys[i].tolist(), cut.shingle_set(i)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary()))],
                names=["kind", "key", "row", "id", "start", "end", "keys", "data"])
    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Exact Jaccard likeness of two packed sorted sets."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated paragraph: id, row, kind, class, start, end, first_id, removed.

    ``start`` and ``end`` count code points, ``first_id`` is the document whose
    occurrence stays, ``row`` stands for the row (its id and text).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "substring")
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(doc_id.alias("id"), text.alias("text"), row_keys(doc_id, text)[0].alias("row"))
    # dealt by key before they are counted: hardly a key recurs within a task
    seen = (rows.select("row", "text").mapInArrow(_hashes, "key long, val long").repartition("key").groupBy("key")
                .agg(F.min("val").alias("low"), F.max("val").alias("high")).filter("low <> high"))
    repeated = spark.sparkContext.broadcast(hash_bitmap(seen, "key"))
    found = scratch.keep(rows.mapInArrow(_found(repeated), _FOUND), "found")

    items = scratch.keep_by(found.filter("kind = 'item'").groupBy(F.col("key").alias("id"))
                                 .agg(F.first("keys").alias("keys"), F.first("data").alias("data")), "items", "id")
    keyed = items.select("id", "keys")
    members = scratch.keep(lsh.buckets(keyed, scratch), "members")
    scratch.drop("shared-keys")
    _, roots = lsh.links(keyed, members, items.select("id", "data"), jaccard, LEAST, scratch,
                          shared=lsh.shared_of_union(LEAST))
    scratch.drop("members", "items")
    places = ["row", "id", "start", "end"]
    lines = (found.filter("kind = 'line'").join(roots.withColumnRenamed("id", "key"), "key", "left")
                  .select("kind", F.coalesce("root", "key").alias("class"), *places))
    spans = found.filter("kind = 'span'").select("kind", F.col("key").alias("class"), *places)
    every = scratch.keep(lines.unionByName(spans), "every")
    scratch.drop("found")
    order = F.struct(F.col("id").isNotNull().alias("named"), "id", "row", "start")
    # written, so that the join below is one of two shuffles and a hot class can be split
    classes = scratch.keep(every.groupBy("kind", "class")
                                .agg(F.min(order).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
                                .filter("low <> high").drop("low", "high"), "classes")
    return (every.join(classes, ["kind", "class"])
                 .select("id", "row", "kind", "class", "start", "end", F.col("first.id").alias("first_id"),
                         (~order.eqNullSafe(F.col("first"))).alias("removed")))


def merged_spans(found: DataFrame) -> DataFrame:
    """(id, start, end, removed, first_id, repeats) with overlapping paragraphs of a document joined.

    ``repeats`` lists the joined paragraphs' (kind, class, first_id), so no link
    to a first occurrence is lost; ``first_id`` is the least of them.
    """
    before = Window.partitionBy("row", "removed").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "removed").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    return (found.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(upto))
                 .groupBy("row", "removed", "_run")
                 .agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"),
                      F.min("first_id").alias("first_id"),
                      F.array_sort(F.collect_set(F.struct("kind", "class", "first_id"))).alias("repeats"))
                 .select("id", "start", "end", "removed", "first_id", "repeats"))
