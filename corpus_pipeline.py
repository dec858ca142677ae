"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from msgaudit.llm import exact_dedup, mixing, near_dup, packing, toxicity
from msgaudit.llm.common import Scratch, read


def drop_toxic(spark, docs, sf_dir):
    """Toxicity: documents that the network scores at 0.3 or more go, the others stay as they are."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_exact_copies(spark, docs, sf_dir):
    """Exact dedup: of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Near-dedup: of each class of near copies the row with the smallest id stays."""
    return near_dup.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Mixing: every document as often as the mix takes it."""
    return mixing.emit(docs)


def pack_sequences(spark, docs, sf_dir):
    """Packing: the pieces of all documents with their sequences and places."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mix", mix_sources), ("pack", pack_sequences)]

#: The network and the near-copy classes have no SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs, kept = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if kept:
                scratch.drop(kept)
            kept = name
    return docs
