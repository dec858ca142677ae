"""Inputs shared by the corpus tests."""
import os
import random

import pyarrow.dataset as ds

SF = "/root/testdata/sf0.001"
#: Extra columns named like the operators' own.
CLASH = "id long, size long, key string, row long, n long, keys string, h long, root long, text_key long, copies long, _c long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH


def words(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(3)
    base, long = words(rnd, 120), words(rnd, 30_000, 5000)
    near = base.split()
    near[10], near[60] = "other", "changed"
    texts = [(1, base, "a"), (2, base.upper(), "a"), (3, " ".join(near), None), (4, None, "b"), (5, "", "b"), (6, "short", None),
             (None, base, "c"), (None, None, None), (7, long, "c"), (8, long + " end", "c"), (9, words(rnd, 80), "a"),
             (9, words(rnd, 80), "a"), (10, "twice the same row", "b"), (10, "twice the same row", "b"),
             (11, "one line\n" + base + "\nlast line", "a"), (12, " \t\n ", "a"), (13, "x" * 5000, "b")]
    return [(i, t, "en" if i else None, s, None) + (7, 7, "k", 7, 7, "k", 7, 7, 7, 7, 7) for i, t, s in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA).repartition(3)


def small(spark, rows):
    """(doc_id, text[, source]) rows as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) + (None,) * 11 for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def documents(sf=SF):
    return ds.dataset(os.path.join(sf, "documents.parquet")).to_table().to_pylist()
