"""Hard-negative mining by a secondary sort.

Every anchor is scored against all rows, block by block: rows and anchors are
packed into matrices of bounded size, each block of rows meets each block of
anchors once (an equi-join on lanes: a block of rows lies in one lane, a block
of anchors in all), and one matrix product gives their integer inner products.

Of a pair of blocks only what can be among an anchor's results leaves the task:
its first ``positives`` rows of the same label, and, once the positives are
known, the first ``negatives`` rows of other labels at or below each positive's
upper bound.  Leaving out the rest loses nothing: a row behind so many others of
its own block is behind them in the whole table too.

The surviving scores are packed into keys (anchor, descending score, positives
first, id), dealt by anchor and sorted by the shuffle
(``repartitionAndSortWithinPartitions``).  One iterator then streams each
partition: a positive opens its window [low, high] below its score, a negative
is emitted for every open window that it lies in, a full or passed window is
closed.  No anchor's rows are ever held together.

Rows without id, label or vector, or with a null or non-finite component, take
no part.  Every row counts by itself, also where an id occurs more than once;
rows of equal id and score are equal for the result.  Vectors of different
lengths are compared as if the shorter ended in zeros; empty vectors score 0.
Scores beyond 2**62 in size count as 2**62.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

POSITIVES, NEGATIVES = 5, 3
#: A negative's share of the positive's score lies between these per cents.
LOW, HIGH = 50, 95
#: Components are taken in units of 1 / SCALE.
SCALE = 256
#: Rows of a block, and bytes of its matrix.
BLOCK_ROWS, ANCHOR_ROWS, BLOCK_BYTES = 8192, 512, 4 << 20
#: Blocks of rows in one lane.
LANE_BLOCKS = 4
#: Scores below this size are exact in float64 and leave room for a place in the block beside them.
EXACT = 1 << 49
LIMIT = 1 << 62

BLOCK_SCHEMA = "block long, rows int, dims int, keys binary, ids binary, labels binary, data binary"
PAIR_SCHEMA = "anchor long, anchor_id long, score long, kind int, id long"
RESULT_SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                 "negative_score long")
_KEY = struct.Struct(">QQBQ")
_BIAS = 1 << 63


# ------------------------------------------------------------------ blocks

def _matrix(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The quantised vectors, padded with zeros, and which of them are whole."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    row, ok = np.repeat(np.arange(len(lengths)), lengths), np.ones(len(lengths), bool)
    ok[row[~np.isfinite(flat)]] = False
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, at] = np.clip(np.floor(flat * scale), -1e300, 1e300)
    return out, ok


def _pack(block: int, keys, ids, labels, data) -> dict:
    order = np.argsort(ids, kind="stable")  # the place in a block breaks ties as the id does
    return {"block": block, "rows": len(ids), "dims": data.shape[1],
            "keys": keys[order].tobytes(), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(),
            "data": np.ascontiguousarray(data[order]).tobytes()}


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (key, id, label, vector) as matrices of at most ``size`` rows."""
    def run(batches):
        from pyspark import TaskContext
        number = (TaskContext.get().partitionId() << 33) - 1
        parts, held = [], 0

        def flush():
            nonlocal number, parts, held
            number += 1
            width = max(p[3].shape[1] for p in parts)
            data = np.vstack([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts])
            out = _pack(number, *(np.concatenate([p[k] for p in parts]) for k in range(3)), data)
            parts, held = [], 0
            return pa.RecordBatch.from_pylist([out], _arrow(BLOCK_SCHEMA))

        for batch in batches:
            data, ok = _matrix(batch.column("vector"), scale)
            cols = [batch.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("key", "id", "label")]
            data = data[ok]
            step = max(1, min(size, BLOCK_BYTES // max(8, 8 * data.shape[1])))
            for lo in range(0, len(data), step):
                more = held + min(step, len(data) - lo)
                width = max([data.shape[1], *(p[3].shape[1] for p in parts)])
                if parts and (more > size or 8 * more * width > BLOCK_BYTES):
                    yield flush()
                parts.append((*(c[lo:lo + step] for c in cols), data[lo:lo + step]))
                held += len(parts[-1][3])
        if parts:
            yield flush()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _unpack(row: dict, side: str):
    shape = (row[f"{side}rows"], row[f"{side}dims"])
    data = np.frombuffer(row[f"{side}data"], np.float64).reshape(shape)
    return data, *(np.frombuffer(row[f"{side}{c}"], np.int64) for c in ("keys", "ids", "labels"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of both."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.zeros((len(a), len(b)), object)
    for k in range(width):
        exact += np.multiply.outer(whole(a[:, k]), whole(b[:, k]))
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _first(score: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first ``n`` allowed scores of each row: higher ones first, then by column."""
    n = min(n, score.shape[1])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if int(np.abs(score).max(initial=0)) < EXACT:
        key = np.where(allowed, score * score.shape[1] - np.arange(score.shape[1]), np.iinfo(np.int64).min)
        best = np.argpartition(key, score.shape[1] - n, axis=1)[:, -n:]
    else:
        best = np.lexsort((np.broadcast_to(np.arange(score.shape[1]), score.shape),
                           np.where(allowed, -score, np.iinfo(np.int64).max)), axis=1)[:, :n]
    row = np.repeat(np.arange(len(score)), n)
    hit = allowed[row, best.ravel()]
    return row[hit], best.ravel()[hit]


def _pairs(grid: DataFrame, positives: int, negatives: int, high: int, windows: bool) -> DataFrame:
    """What of each pair of blocks can be among the results: (anchor, anchor_id, score, kind, id).

    Without windows the same-label rows (kind 0); with them the rows of other
    labels (kind 1) for the positive scores in ``found``.
    """
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, a_key, a_id, a_label = _unpack(row, "a_")
                b, b_key, b_id, b_label = _unpack(row, "")
                score, same = scores(a, b), a_label[:, None] == b_label[None, :]
                if windows:
                    found = np.frombuffer(row["found"], np.int64).reshape(len(a), positives)
                    hits = []
                    for k in range(positives):  # a missing window is -LIMIT - 1: nothing is below it
                        ok = ~same & (score <= np.array([high * int(s) // 100 for s in found[:, k]])[:, None])
                        hits.append(np.stack(_first(score, ok, negatives)))
                    at = np.unique(np.concatenate(hits, axis=1), axis=1)
                    i, j, kind = at[0], at[1], 1
                else:
                    i, j = _first(score, same & (a_key[:, None] != b_key[None, :]), positives)
                    kind = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a_key[i]), pa.array(a_id[i]), pa.array(score[i, j]),
                     pa.array(np.full(len(i), kind, np.int32)), pa.array(b_id[j])], schema=_arrow(PAIR_SCHEMA))

    return grid.mapInArrow(run, PAIR_SCHEMA)


def _grid(rows: DataFrame, anchors: DataFrame, lanes: int) -> DataFrame:
    """Every block of rows beside every block of anchors, by lanes."""
    left = rows.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    right = anchors.select(*[F.col(c).alias(f"a_{c}" if c in BLOCK_COLUMNS else c) for c in anchors.columns],
                           F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return left.join(right, "lane")


BLOCK_COLUMNS = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


# ---------------------------------------------------------- secondary sort

def pack_key(anchor: int, score: int, kind: int, item: int) -> bytes:
    """A key whose byte order is: anchor, higher scores, positives, smaller ids."""
    return _KEY.pack(anchor + _BIAS, _BIAS - 1 - score, kind, item + _BIAS)


def _unpack_key(key: bytes):
    anchor, score, kind, item = _KEY.unpack(key)
    return anchor - _BIAS, _BIAS - 1 - score, kind, item - _BIAS


def secondary_sort(pairs: DataFrame, parts: int):
    """The pairs dealt by anchor, each partition sorted by the packed key."""
    keyed = pairs.rdd.map(lambda r: (pack_key(r.anchor, r.score, r.kind, r.id), r.anchor_id))
    return keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))


def first_positives(stream, positives: int):
    """The first ``positives`` pairs of each anchor of a sorted partition."""
    last, seen = None, 0
    for key, anchor_id in stream:
        anchor, score, _, item = _unpack_key(key)
        seen = seen + 1 if anchor == last else 1
        last = anchor
        if seen <= positives:
            yield anchor, anchor_id, score, 0, item


def window_negatives(stream, negatives: int, low: int, high: int):
    """Negatives of each positive of a sorted partition; only open windows are held."""
    last, windows = None, []
    for key, anchor_id in stream:
        anchor, score, kind, item = _unpack_key(key)
        if anchor != last:
            last, windows = anchor, []
        if kind == 0:
            windows.append([item, score, 0])
            continue
        for window in windows:
            if low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor_id, window[0], window[2], item, window[1], score
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]


# ---------------------------------------------------------------- operator

def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id and both scores.

    ``is_anchor`` is a condition on the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "negatives")
    name = [f"`{c}`" for c in (id_col, label_col, vector_col)]
    rows = (vectors.select(F.col(name[0]).cast("long").alias("id"), F.col(name[1]).cast("long").alias("label"),
                           F.col(name[2]).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
                   .filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    n = rows.count()
    rows = scratch.keep(rows.repartition(max(1, math.ceil(n / BLOCK_ROWS)))
                            .withColumn("key", F.monotonically_increasing_id()), "rows")  # a key that stays, as it is written
    blocks = scratch.keep(_blocks(rows, BLOCK_ROWS, scale), "blocks")
    asked = rows.filter("is_anchor").repartition(max(1, math.ceil(n / BLOCK_ROWS / 16)))
    anchors = scratch.keep(_blocks(asked, ANCHOR_ROWS, scale), "anchors")
    lanes = max(1, math.ceil(blocks.count() / LANE_BLOCKS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    kept = scratch.keep(_pairs(_grid(blocks, anchors, lanes), positives, negatives, high, False), "same")
    first = secondary_sort(kept, parts).mapPartitions(lambda s: first_positives(s, positives))
    found = scratch.keep(spark.createDataFrame(first, PAIR_SCHEMA), "positives")
    scratch.drop("same")

    opened = scratch.keep(_with_windows(anchors, found, positives), "opened")
    other = scratch.keep(_pairs(_grid(blocks, opened, lanes), positives, negatives, high, True), "other")
    mined = (secondary_sort(found.unionByName(other), parts)
             .mapPartitions(lambda s: window_negatives(s, negatives, low, high)))
    out = scratch.keep(spark.createDataFrame(mined, RESULT_SCHEMA), "mined")
    scratch.drop("rows", "blocks", "anchors", "positives", "opened", "other")
    return out


def _with_windows(anchors: DataFrame, found: DataFrame, positives: int) -> DataFrame:
    """Blocks of anchors with the scores of their positives, ``positives`` to an anchor."""
    def keys(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = np.frombuffer(row["keys"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["block"])), pa.array(key),
                                                  pa.array(np.arange(len(key), dtype=np.int32))],
                                                 names=["block", "anchor", "place"])

    def fill(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                scores_of = np.full((row["rows"], positives), -LIMIT - 1, np.int64)
                for hit in row.pop("hits") or []:
                    own = sorted(hit["scores"], reverse=True)
                    scores_of[hit["place"], :len(own)] = own
                out.append({**row, "found": scores_of.tobytes()})
            yield pa.RecordBatch.from_pylist(out, _arrow(BLOCK_SCHEMA + ", found binary"))

    place = anchors.select("block", "rows", "keys").mapInArrow(keys, "block long, anchor long, place int")
    each = found.groupBy("anchor").agg(F.collect_list("score").alias("scores"))  # at most ``positives``
    hits = (place.join(each, "anchor").groupBy("block")
                 .agg(F.collect_list(F.struct("place", "scores")).alias("hits")))  # at most ANCHOR_ROWS
    return anchors.join(hits, "block").mapInArrow(fill, BLOCK_SCHEMA + ", found binary")
