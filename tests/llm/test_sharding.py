import zlib
from collections import defaultdict

import numpy as np

from msgaudit.llm import sharding

from .helpers import documents, frame, small


def test_permutation_for_every_size():
    for n in [1, 2, 3, 4, 5, 15, 16, 17, 100, 1000, 4097]:
        assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))
    a = sharding.permute(np.arange(1000), 1000)
    assert (a == sharding.permute(np.arange(1000), 1000)).all() and (a != sharding.permute(np.arange(1000), 1000, 1)).any()
    assert abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.1


def check(out):
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
        assert r["position"] == r["slot"] * 16 + r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[k]) for k in range(16)]
    assert set(shards) <= set(range(16)) and max(sizes) - min(sizes) <= 1


def test_documents(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    out = sharding.shard(small(spark, rows)).collect()
    check(out)
    place = {r["id"]: r for r in out}
    want = sharding.permute(np.arange(len(rows)), len(rows))
    for k, (i, t) in enumerate(sorted(rows)):
        r = place[i]
        assert (r["size"], r["text_crc32"], r["position"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), want[k])
    again = {r["id"]: r["position"] for r in sharding.shard(small(spark, rows).repartition(9)).collect()}
    assert again == {i: r["position"] for i, r in place.items()}


def test_awkward_rows(spark):
    df = frame(spark)
    out = sharding.shard(df).collect()
    assert len(out) == df.count()
    check(out)
    assert sharding.shard(frame(spark, [])).count() == 0
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in out if r["id"] in (4, 5))
