"""Mixing sources to target weights by systematic sampling.

Targets: the sources, ordered by code point with null last, get the given
weights in turn; a source takes at most ``max_copies`` times its own size, and
what it cannot take is shared among the others by weight until none is above.

Sampling: within a source every document expects the same number of copies,
target / size.  The expected copies are prefix-summed over the source's
documents in (size, id) order, one offset drawn from the seed and the source's
name is added, and a document is emitted once per integer boundary that its
interval crosses.  Sorting by size makes the systematic sample stratified by
size, so the words taken stay within about one document of the target.

Null texts have size 0, null sources form one source, rows that are equal in
every respect are told apart by their position only.  A source without words
gets target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, deal_out, global_index, row_keys

#: Weights that the ordered sources take in turn.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size; so is what a document gives.
MAX_COPIES = 3
SEED = 42


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), from the seed and its name."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n) -> the same with ``target`` (double).

    The level per unit of weight is raised in rounds of one aggregation each
    until no further source reaches its limit; one row of sums per round comes
    to the driver, never the sources.
    """
    ranked = global_index(sizes, [F.col("source").asc_nulls_last()], scratch, "sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_idx") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", turn.cast("long")).withColumn("most", F.col("source_size") * max_copies)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at_limit = F.col("most") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        n, taken, open_weight = ranked.agg(
            F.count_if(at_limit), F.sum(F.when(at_limit, F.col("most")).otherwise(0)),
            F.sum(F.when(at_limit, 0).otherwise(F.col("weight")))).first()
        if n == full or not open_weight:
            break
        level, full = float(total - (taken or 0)) / float(open_weight), n
    return ranked.select("source", "source_size", "n", F.least(F.col("most").cast("double"),
                                                               F.lit(level) * F.col("weight")).alias("target"))


def _identity(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"),
            F.col(f"`{text_col}`").cast("string")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (and the row's keys)."""
    scratch = Scratch(docs.sparkSession, "mix")
    doc_id, source, text = _identity(id_col, text_col, source_col)
    slim = docs.select(doc_id.alias("id"), source.alias("source"), word_count(text).alias("size"),
                       *row_keys(doc_id, source, text))
    rows = global_index(slim, [F.col("source").asc_nulls_last(), F.col("size"), F.col("id"), F.col("_k1")],
                        scratch, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    first = rows.groupBy("source").agg(F.min("_idx").alias("_first"))
    targets = source_targets(sizes, scratch, weights, max_copies)
    per_source = (targets.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                         .select(F.col("source").alias("_src"), "source_size", "target", "_first",
                                 F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                  .otherwise(F.lit(0.0)).alias("_rate"), offset(F.col("source"), seed).alias("_u")))
    per_source = scratch.keep(per_source, "targets")
    nth = F.col("_idx") - F.col("_first")
    return (rows.join(per_source, F.col("source").eqNullSafe(F.col("_src")))
                .withColumn("copies", (F.floor((nth + 1) * F.col("_rate") + F.col("_u"))
                                       - F.floor(nth * F.col("_rate") + F.col("_u"))).cast("long"))
                .select("id", "size", "source", "source_size", "target", "copies", "_k1", "_k2"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns."""
    taken = mix(docs, id_col, text_col, source_col, **how)
    counts = taken.groupBy("_k1", "_k2").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    return deal_out(docs, _identity(id_col, text_col, source_col), counts.filter("copies > 0"))
