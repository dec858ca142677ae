"""Links between items whose sketches collide, without all pairs of a bucket.

An item has keys (one to a band, into which its number is mixed); items with a
key in common share a bucket.  What is linked forms components.  Any two items that share a bucket and are
like each other end up in one component, whatever the size of the bucket:

* In a bucket of at most ``small`` + 1 items every pair is verified.
* In a larger one every item is verified against one of them, the leader.  Then
  components are formed, and buckets that lie within one are done.
* The items of the other large buckets are joined by their rarest tokens.  The
  payloads are multisets of 32-bit numbers, and the likeness must be such that
  items that are like share ``least`` of the larger multiset.  So, with all
  tokens in one order, they share one among their first n - least * n + 1; the
  order is by frequency, so that what many texts have in common comes last.
  All that two items share stands behind the first token that they share, so a
  pair whose places of the token leave too little behind them is none.  Nor is one
  whose parities differ in more bits than the tokens that only one of two items
  that are like may hold: each item has ``PARITY`` bits, and each of its tokens
  turns one of them.  Pairs with such a token, a bucket in common and different
  components are verified.  A pair meets at the first token that it shares: where
  both have one in common among the ``BEFORE`` ones before, it has met there.

So a bucket of near copies of one text costs a pair an item, a bucket of items
around one frequent passage costs the pairs with a rare token in common, and
nothing is capped or left to chance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, hash_bitmap, in_bitmap

SMALL = 4
#: Tokens are ordered by counts in so many cells (a power of two); any order gives the same links.
CELLS = 1 << 18
#: Bits of an item's parity (whole longs); two items differ in no more of them than in tokens.
PARITY = 256
#: Bits in which an item's buckets are marked where items meet by their tokens; the keys decide later.
KEY_BITS = 128
#: Tokens before a token that come with it, so a pair that shares several is mostly made once; any number gives the same pairs.
BEFORE = 16


def _in_shared(shared):
    """(key, id, size) of the items' keys in the bitmap, each once an item; the size if items have one."""
    def run(batches):
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            some = in_bitmap(shared.value, keys)
            keys, owner = keys[some], owner[some]
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])] if len(keys) else np.empty(0, bool)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[new]), **{c: batch.column(c).take(pa.array(owner[new]))
                                                                             for c in batch.schema.names if c != "keys"}})
    return run


def buckets(items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, keys) -> (key, id) of the buckets that two items or more share; a ``size`` of the items comes with them.

    Hardly a key is shared: they are counted first, and a bitmap of those that
    are lets no other one be sent with its item.
    """
    scratch = scratch or Scratch(items.sparkSession, "buckets")
    shared = scratch.keep(items.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key")
                               .agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    bitmap = items.sparkSession.sparkContext.broadcast(hash_bitmap(shared, "key"))
    more = ["size"] if "size" in items.columns else []
    return items.select("id", "keys", *more).mapInArrow(
        _in_shared(bitmap), "key long, id long" + ", size int" * len(more)).join(shared, "key")


def alike_in_size(shared: Callable[[Column, Column], Column]) -> Column:
    """Whether ``size_a`` and ``size_b`` allow that two items share what two that are like do."""
    return F.least("size_a", "size_b") >= shared(F.col("size_a"), F.col("size_b")) - 1e-6


def sized_alike(pairs: DataFrame, payload: DataFrame, shared: Callable[[Column, Column], Column]) -> DataFrame:
    """The (a, b) of ``pairs`` whose payloads' sizes are :func:`alike_in_size`; the others move no payload."""
    size = lambda c: payload.select(F.col("id").alias(c), (F.octet_length("data") / 4).alias(f"size_{c}"))
    return pairs.join(size("a"), "a").join(size("b"), "b").filter(alike_in_size(shared)).select("a", "b")


def verify_pairs(pairs: DataFrame, payload: DataFrame, likeness: Callable[[bytes, bytes], float]) -> DataFrame:
    """(a, b) -> (a, b, like), the payloads of both sides compared in the task; if they
    come with ``keys``, only of pairs with a key in common."""
    keyed = "keys" in payload.columns

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"],
                                "like": [likeness(x, y) for x, y in zip(pdf["x"], pdf["y"])]})
    side = lambda c, x: payload.select(F.col("id").alias(c), F.col("data").alias(x), *[F.col("keys").alias(f"keys_{c}")] * keyed)
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    if keyed:
        both = both.filter(F.arrays_overlap("keys_a", "keys_b"))
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long, like double")


def labelled(data: bytes) -> np.ndarray:
    """The numbers of a packed multiset as 64-bit tokens, equal ones told apart by their occurrence."""
    values = np.sort(np.frombuffer(data, np.uint32)).astype(np.uint64)
    at = np.arange(len(values))
    run = np.maximum.accumulate(np.where(np.r_[True, values[1:] != values[:-1]], at, 0)) if len(values) else at
    token = (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (at - run).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    token = (token ^ (token >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return token ^ (token >> np.uint64(29))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Longs in which every token has turned one bit: the bits in which two differ bound the tokens not shared."""
    at = ((tokens >> np.uint64(40)) & np.uint64(PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def key_bits(keys) -> np.ndarray:
    """Longs with a bit for every key, so items with a key in common have a bit in common."""
    bits = np.zeros(KEY_BITS, np.uint8)
    bits[(np.array(keys, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(KEY_BITS)] = 1
    return np.packbits(bits).view(np.int64)


_PARITIES, _KEY_BITS = [f"p{j}" for j in range(PARITY // 64)], [f"k{j}" for j in range(KEY_BITS // 64)]
_BITS = _PARITIES + _KEY_BITS


def _count(batches):
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for data in batch.column("data").to_pylist():
            np.add.at(seen, _cell(labelled(data)), 1)
    cells = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(seen[cells])})


def _first(data: bytes, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of an item, one of which all that are like it share, in their order; and all its tokens."""
    tokens = labelled(data)
    first = len(tokens) - int(np.ceil(least * len(tokens) - 1e-6)) + 1
    return tokens[np.lexsort((tokens, counts[_cell(tokens)]))[:first]].view(np.int64), tokens


def _first_tokens(counts, least: float):
    """(token, out) of the first tokens of every item."""
    def run(batches):
        for batch in batches:
            found = [_first(data, counts.value, least)[0] for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(np.concatenate([*found, np.empty(0, np.int64)])),
                "out": pa.array(np.repeat(batch.column("out").to_numpy(zero_copy_only=False), [len(f) for f in found]))})
    return run


def _rarest(counts, least: float, shared):
    """The first tokens of every item that the bitmap says another has, each with up to ``BEFORE`` such before it."""
    def run(batches):
        for batch in batches:
            found, places, before, bits = [], [], [], []
            for data, keys in zip(batch.column("data").to_pylist(), batch.column("keys").to_pylist()):
                first, tokens = _first(data, counts.value, least)
                place = np.flatnonzero(in_bitmap(shared.value, first))
                found.append(first[place])
                places.append(place)
                before += [found[-1][max(0, k - BEFORE):k] for k in range(len(place))]
                bits.append(np.r_[parity(tokens), key_bits(keys)])
            n = [len(f) for f in found]
            bits = np.repeat(np.array(bits, np.int64).reshape(-1, len(_BITS)), n, axis=0)
            each = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)
            size = np.array([len(d) // 4 for d in batch.column("data").to_pylist()], np.int64)
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(np.concatenate([*places, none])), "id": pa.array(each("id")), "root": pa.array(each("root")),
                "out": pa.array(each("out")), "size": pa.array(np.repeat(size, n)), "token": pa.array(np.concatenate([*found, none])),
                "before": pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in before]), pa.int32()),
                                                   pa.array(np.concatenate([*before, none]))),
                **{p: pa.array(bits[:, j]) for j, p in enumerate(_BITS)}})
    return run


def shared_of_larger(least: float) -> Callable[[Column, Column], Column]:
    """Items that are like share ``least`` of the larger one."""
    return lambda a, b: F.greatest(a, b) * least


def shared_of_union(least: float) -> Callable[[Column, Column], Column]:
    """Items that are like share ``least`` of all that stands in either (Jaccard likeness)."""
    return lambda a, b: (a + b) * (least / (1 + least))


def rare_pairs(left: DataFrame, payload: DataFrame, least: float, scratch: Scratch,
               shared: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b) of all items of ``left`` (id, root, out, keys) that may be like each other: of different
    components, at least one of them ``out``, with one of the rarest tokens in common and, so far as
    ``KEY_BITS`` bits tell, a key; and the written table ``people`` with their keys and data.
    ``shared`` gives, from the sizes, what two that are like share at least."""
    people = scratch.keep(left.join(payload, "id"), "people")
    cells = people.select("data").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    order = people.sparkSession.sparkContext.broadcast(counts)
    # most of the first tokens stand in one item alone
    held = people.select("out", "data").mapInArrow(_first_tokens(order, least), "token long, out boolean").groupBy("token").agg(
        F.count("*").alias("n"), F.max("out").alias("out"))
    shared_tokens = people.sparkSession.sparkContext.broadcast(hash_bitmap(held.filter("n > 1 and out"), "token"))
    rare = scratch.keep(people.select("id", "root", "out", "keys", "data").mapInArrow(
        _rarest(order, least, shared_tokens), "place long, id long, root long, out boolean, size long, token long, before array<long>, "
        + ", ".join(f"{p} long" for p in _BITS)), "rare")
    # what stands at the token and behind it, in either item, bounds what they can share, and so do the parities
    behind = lambda c: F.col(f"size_{c}") - F.col(f"place_{c}")
    side = lambda df, c: df.select("token", *[F.col(x).alias(f"{x}_{c}") for x in ("place", "id", "root", "size", "before", *_BITS)])
    enough = (shared or shared_of_larger(least))(F.col("size_a"), F.col("size_b")) - 1e-6
    differ = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in _PARITIES)
    bucket = reduce(Column.__or__, [F.col(f"{k}_a").bitwiseAND(F.col(f"{k}_b")) != 0 for k in _KEY_BITS])
    out, rest = rare.filter("out"), rare.filter("not out")

    def met(other: DataFrame, once: Column) -> DataFrame:
        return side(out, "a").join(side(other, "b"), "token").filter(
            (F.col("root_a") != F.col("root_b")) & once & bucket
            & (F.least("size_a", "size_b", behind("a"), behind("b")) >= enough)
            & (differ <= F.col("size_a") + F.col("size_b") - 2 * enough)
            & ~F.arrays_overlap("before_a", "before_b")  # they have met at a token before
        ).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    # the items that are out on both sides and with the others: each is shuffled once
    pairs = met(out, F.col("id_a") < F.col("id_b")).union(met(rest, F.col("id_a") != F.col("id_b"))).distinct()
    return pairs, people.select("id", "keys", "data")


def links(items: DataFrame, members: DataFrame, payload: DataFrame, likeness: Callable[[bytes, bytes], float],
          least: float, scratch: Scratch, small: int = SMALL,
          shared: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, like) of at least ``least``, and (id, root) of the components.

    ``items`` are (id, keys), ``members`` their :func:`buckets`, ``payload``
    (id, data) what ``likeness`` compares; the last two are written tables, the
    payload best bucketed by id (:meth:`Scratch.keep_by`).  Members with a
    ``size``, the numbers in their payload, pair where sizes allow it only.
    ``shared`` as in :func:`rare_pairs`.
    """
    def verified(pairs, payload, name):
        kept = scratch.keep(pairs, f"pairs-{name}")
        out = scratch.keep(verify_pairs(kept, payload, likeness).filter(F.col("like") >= least), f"links-{name}")
        scratch.drop(f"pairs-{name}")
        return out

    known, most = "size" in members.columns, shared or shared_of_larger(least)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("id", "size") if known else F.struct("id")).alias("lead"))
    sized = scratch.keep(members.join(sizes, "key").select(*members.columns, "n", F.col("lead.id").alias("lead"),
                                                           *[F.col("lead.size").alias("lead_size")] * known), "sized")
    few, many = sized.filter(F.col("n") <= small + 1), sized.filter(F.col("n") > small + 1)
    side = lambda c: few.select("key", F.col("id").alias(c), *[F.col("size").alias(f"size_{c}")] * known)
    every = side("a").join(side("b"), "key").filter("a < b").drop("key")
    star = many.filter("id <> lead").select(F.col("id").alias("a"), *[F.col("size").alias("size_a")] * known,
                                            F.col("lead").alias("b"), *[F.col("lead_size").alias("size_b")] * known)
    every = every.select(star.columns).union(star)
    if known:
        found = verified(every.filter(alike_in_size(most)).select("a", "b").distinct(), payload, "first")
    else:
        pairs = scratch.keep(every.distinct(), "pairs-all")
        found = verified(sized_alike(pairs, payload, most), payload, "first")
        scratch.drop("pairs-all")
    roots = scratch.keep(components(found, scratch, "components"), "roots-first")

    rest = many.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    main = (rest.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
                .agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("parts > 1"))
    # with the keys of these buckets alone: the pairs of the smaller ones are verified
    left = scratch.keep(rest.join(main, "key").groupBy("id", "root").agg(F.max(F.col("root") != F.col("main")).alias("out"),
                                                                         F.collect_list("key").alias("keys")), "left")
    scratch.drop("sized")
    if left.limit(1).count():
        more = verified(*rare_pairs(left, payload, least, scratch, shared), "rest")
        scratch.drop("people", "rare")
        if more.limit(1).count():
            found = found.union(more)  # of different components, so no link is there twice
            edges = more.select("a", "b").union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
            roots = scratch.keep(components(edges, scratch, "components-all"), "roots")
    return found, roots
