import hashlib
from collections import defaultdict

import numpy as np

from msgaudit.llm import exact_dedup
from msgaudit.llm.common import hash_bitmap, in_bitmap

from .helpers import frame, small


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(i)
    return groups


def test_awkward_rows(spark):
    df = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = exact_dedup.exact_dedup(df, every_digest=True).collect()
    groups = expected(rows)
    assert len(out) == len(rows)
    digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in out:
        ids = digests[r["digest"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
        kept[r["digest"]] += r["kept"]
    assert all(v == 1 for v in kept.values()) and len(kept) == len(groups)


def test_full_hash_only_for_survivors(spark):
    df = small(spark, [(1, "abc"), (2, "abd"), (3, "longer"), (4, "ABC")])
    out = {r["id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert out[3]["digest"] is None and out[2]["digest"] is None
    assert out[1]["digest"] == out[4]["digest"] is not None and out[1]["keep_id"] == 4


def test_keep_one_has_all_columns(spark):
    df = frame(spark)
    out = exact_dedup.keep_one(df)
    assert out.columns == df.columns
    texts = [(r["text"] or "").lower() for r in out.collect()]
    assert len(texts) == len(set(texts)) == len(expected([(0, r["text"]) for r in df.collect()]))


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    keys = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 3000).tolist() + [0, -1, 2 ** 63 - 1, -2 ** 63]
    bitmap = hash_bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), "key", 20)
    assert in_bitmap(bitmap, np.array(keys)).all() and bitmap.nbytes == 1 << 17
    assert np.unpackbits(bitmap).sum() <= len(keys)
