import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from msgaudit.llm import lsh, near_dup, substring
from msgaudit.llm.common import Scratch

from .helpers import documents, frame, small, words


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


short = st.lists(st.integers(0, 4), max_size=40)


@settings(max_examples=300, deadline=None)
@given(short, short, st.integers(0, 40))
def test_banded_alignment(a, b, most):
    d = brute(a, b)
    assert near_dup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(d, most + 1)


def test_order_minhash_keeps_the_order():
    rnd = np.random.default_rng(0)
    text = rnd.integers(0, 2 ** 32, 300).astype(np.uint32)
    swapped = np.r_[text[150:], text[:150]]
    both, starts = np.concatenate([text, swapped]), np.array([0, 300])
    keys = near_dup.order_minhash(*near_dup.labelled_kmers(both, starts, 5), 40)
    assert 0.2 < (keys[0] == keys[1]).mean() < 0.8  # the same k-mers, but half of the pairs change sides


def chance(n, k, bands):
    return 1 - (1 - near_dup.agreement(n, k)) ** bands


def test_bands_reach_the_recall():
    """Texts with 10, 15 and 20 % of their words changed collide, all likenesses that are verified."""
    rnd = np.random.default_rng(3)
    assert all(chance(n, 2, near_dup.SHORT_BANDS) >= 0.999 for n in range(near_dup.SURE_WORDS, near_dup.LONG_WORDS))
    assert all(chance(n, 2, near_dup.SHORT_BANDS) >= 0.99 for n in range(near_dup.FEW_WORDS + 1, near_dup.LONG_WORDS))
    assert all(chance(n, 3, near_dup.LONG_BANDS) >= 0.95 for n in range(near_dup.LONG_WORDS, 4000))
    for n, pairs in ((18, 1000), (60, 1000), (70, 1000), (300, 300)):
        for share in (0.10, 0.15, 0.20):
            texts = []
            for k in range(pairs):
                text = rnd.integers(0, 2 ** 31, n).astype(np.uint32)
                other = text.copy()
                other[rnd.choice(n, int(n * share), replace=False)] += np.uint32(2 ** 31)
                assert near_dup.likeness(text.tobytes(), other.tobytes()) >= 0.8
                texts.append((text, other))
            met = sum(bool(set(a) & set(b)) for a, b in zip(*(near_dup.sketch_keys([t[side] for t in texts]) for side in (0, 1))))
            assert met >= 0.985 * pairs, (n, share, met)


def test_lengths_on_both_sides_of_a_border_share_keys():
    """Words inserted, so that the two texts lie on different sides of FEW_WORDS and LONG_WORDS."""
    rnd = np.random.default_rng(4)
    for n, more in ((13, 3), (14, 2), (58, 12), (62, 4), (52, 13)):
        met = 0
        for _ in range(400):
            long = rnd.integers(0, 2 ** 32, n + more).astype(np.uint32)
            short = np.delete(long, rnd.choice(n + more, more, replace=False))
            assert near_dup.likeness(short.tobytes(), long.tobytes()) >= 0.8
            a, b = near_dup.sketch_keys([short, long])
            met += bool(set(a) & set(b))
        assert met >= 0.97 * 400, (n, more, met)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_few_words_always_share_a_key(a, b):
    a, b = np.array(a, np.uint32), np.array(b, np.uint32)
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    if len(a) and len(b) and brute(a.tolist(), b.tolist()) <= most:
        x, y = near_dup.sketch_keys([a, b])
        assert set(x) & set(y)


def test_short_texts_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(0, "one two three four five"), (1, "one two nine four five"), (2, "one two three four"), (3, "one two three"), (4, "one")]
    for k in range(60):
        w = words(rnd, rnd.randrange(1, 15), 9).split()
        for c in range(3):
            v = list(w)
            for _ in range(rnd.randrange(3)):
                at = rnd.randrange(len(v) + 1)
                v[at:at + rnd.randrange(2)] = rnd.choice([[], [f"n{rnd.randrange(4)}"]])
            rows.append((10 + 3 * k + c, " ".join(v)))
    seqs = {i: t.split() for i, t in rows}
    root = {i: i for i in seqs}
    for a in seqs:
        for b in seqs:
            if a < b and root[a] != root[b] and brute(seqs[a], seqs[b]) <= int(0.2 * max(len(seqs[a]), len(seqs[b])) + 1e-9):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    out = {r["id"]: r["class_id"] for r in near_dup.near_dedup(small(spark, rows)).collect()}
    assert out == root and root[0] == root[1] == root[2] == 0 and root[3] != 0


def test_classes_against_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in documents()]
    rnd = random.Random(5)
    for k in range(12):
        w = docs[k * 7][1].split()
        for _ in range(max(1, len(w) // 25)):
            w[rnd.randrange(len(w))] = "edited"
        docs.append((1000 + k, " ".join(w)))
    seqs = {i: near_dup.normalise(t).split() for i, t in docs}
    hasher = near_dup.WordHasher()
    packed = {i: hasher(w) for i, w in seqs.items()}
    root = {i: i for i in seqs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(seqs)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = packed[a], packed[b]
            long = max(len(x), len(y))
            if np.array_equal(x, y) or (long and near_dup.likeness(x.tobytes(), y.tobytes()) >= 0.8):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    out = {r["id"]: r for r in near_dup.near_dedup(small(spark, docs)).collect()}
    assert {i: r["class_id"] for i, r in out.items()} == {i: find(i) for i in ids}
    assert all(r["kept"] == (i == r["class_id"]) for i, r in out.items())


def test_hot_groups_stay_linear_and_whole(spark):
    """A large group of near copies, and many texts around one frequent passage."""
    rnd = random.Random(2)
    base, passage = words(rnd, 60, 9999).split(), words(rnd, 25, 9999)
    near = []
    for k in range(150):
        w = list(base)
        w[rnd.randrange(60)] = f"x{k}"
        near.append((k, " ".join(w)))
    shared = [(1000 + k, passage + " " + words(rnd, 35, 99999)) for k in range(150)]
    out = {r["id"]: r for r in near_dup.near_dedup(small(spark, near + shared)).collect()}
    assert {out[k]["class_id"] for k in range(150)} == {0}
    assert all(out[i]["class_id"] == i for i, _ in shared)


def test_near_copies_among_texts_with_one_passage(spark):
    """Every pair that shares a bucket is decided, however large the bucket and the table."""
    rnd = random.Random(6)
    passage, rows = words(rnd, 40, 99999), []
    for k in range(400):
        w = words(rnd, 40, 99999).split()
        rows.append((k, passage + " " + " ".join(w)))
        if k % 10 == 0:
            for i in rnd.sample(range(40), 12):
                w[i] = f"x{k}x{i}"
            rows.append((1000 + k, passage + " " + " ".join(w)))
    packed = {i: near_dup.WordHasher()(near_dup.normalise(t).split()).tobytes() for i, t in rows}
    out = {r["id"]: r["class_id"] for r in near_dup.near_dedup(small(spark, rows)).collect()}
    assert all(near_dup.likeness(packed[k], packed[1000 + k]) >= 0.8 for k in range(0, 400, 10))
    assert out == {i: i % 1000 for i, _ in rows}


def test_large_buckets_are_exact(spark):
    """One bucket that holds all items: the components are those of all pairs."""
    rnd = random.Random(7)
    sets = [set(rnd.sample(range(1000), 40)) for _ in range(20)]
    sets += [set(rnd.sample(sorted(s), len(s) - 3)) | {2000 + 7 * k, 3000 + k} for k, s in enumerate(sets) for _ in range(4)]
    common = set(range(5000, 5000 + 60))
    packed = [np.array(sorted(s | common), np.uint32).tobytes() for s in sets]
    rows = [(i, [1]) for i in range(len(packed))]
    scratch = Scratch(spark, "test-lsh")
    items = scratch.keep(spark.createDataFrame(rows, "id long, keys array<long>"), "items")
    payload = scratch.keep(spark.createDataFrame(list(enumerate(packed)), "id long, data binary"), "payload")
    members = scratch.keep(lsh.buckets(items), "members")
    _, roots = lsh.links(items, members, payload, substring.jaccard, 0.8, scratch)
    got = {r["id"]: r["root"] for r in roots.collect()}
    want = {i: i for i, _ in rows}
    for a in want:
        for b in range(a):
            if substring.jaccard(packed[a], packed[b]) >= 0.8 and want[a] != want[b]:
                high, low = max(want[a], want[b]), min(want[a], want[b])
                want = {i: low if r == high else r for i, r in want.items()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) > 1


def test_awkward_rows(spark):
    df = frame(spark)
    out = near_dup.near_dedup(df).collect()
    assert len(out) == df.count()
    of = {}
    for r in out:
        of.setdefault(r["id"], set()).add(r["class_id"])
    assert of[1] == of[2] == of[3] == of[11] == {1} and of[4] == of[5] == of[12] == {4} and of[7] == of[8] == {7}
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert kept.filter("doc_id = 10").count() == 1
    assert near_dup.near_dedup(frame(spark, [])).count() == 0 and near_dup.keep_one(frame(spark, [])).count() == 0


def test_parities_and_key_bits_lose_nothing():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ({rnd.getrandbits(64) for _ in range(rnd.randrange(300))} for _ in range(2))
        b |= set(rnd.sample(sorted(a), rnd.randrange(len(a) + 1)))
        pa_, pb = (lsh.parity(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(x).bit_count() for x in (pa_ ^ pb).view(np.uint64)) <= len(a ^ b)
        keys = [rnd.getrandbits(63) for _ in range(30)]
        assert (lsh.key_bits(keys) & lsh.key_bits(keys[7:8])).any()


def test_items_around_one_passage_make_few_pairs(spark):
    """A bucket of items that share a passage and many frequent tokens, but are not like each other."""
    rnd = random.Random(11)
    passage, n = set(range(5000, 5060)), 150
    sets = [passage | set(rnd.sample(range(200), 40)) for _ in range(n)]
    sets[-1] = set(sorted(sets[0])[1:]) | {9000}
    data = [(i, np.array(sorted(s), np.uint32).tobytes()) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "test-pairs")
    payload = scratch.keep(spark.createDataFrame(data, "id long, data binary"), "payload")
    left = spark.createDataFrame([(i, i, True, [1]) for i in range(n)], "id long, root long, out boolean, keys array<long>")
    pairs, people = lsh.rare_pairs(left, payload, 0.8, scratch, lsh.shared_of_union(0.8))
    met = {(r["a"], r["b"]) for r in pairs.collect()}
    assert (0, n - 1) in met and len(met) < n * (n - 1) // 2 // 20
    like = lsh.verify_pairs(pairs, people, substring.jaccard).filter("like >= 0.8").collect()
    assert [(r["a"], r["b"]) for r in like] == [(0, n - 1)]


def test_a_pair_meets_once_by_its_tokens(spark):
    """Items that share nearly all their rare tokens: the join by token makes each pair once, and none is lost."""
    rnd = random.Random(13)
    base = rnd.sample(range(100_000), 100)
    sets = [set(base) - set(rnd.sample(base, 5)) | {200_000 + 10 * k + j for j in range(5)} for k in range(40)]
    data = [(i, np.array(sorted(s), np.uint32).tobytes()) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "test-once")
    payload = scratch.keep(spark.createDataFrame(data, "id long, data binary"), "payload")
    left = spark.createDataFrame([(i, i, True, [1]) for i in range(40)], "id long, root long, out boolean, keys array<long>")
    pairs, _ = lsh.rare_pairs(left, payload, 0.8, scratch)
    met = {(r["a"], r["b"]) for r in pairs.collect()}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    rare = spark.read.parquet(scratch.path("rare"))
    tokens = rare.groupBy("token").count().filter("count < 2").count()
    assert tokens == 0 and rare.select("before").filter("size(before) > 0").count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "arrays_overlap" in plan
    each = rare.alias("a").join(rare.alias("b"), "token").filter("a.id < b.id")
    assert each.count() > 10 * len(met) and each.filter("not arrays_overlap(a.before, b.before)").count() <= 1.2 * len(met)


def test_only_shared_keys_are_sent_with_their_items(spark):
    """A key that one item has, even twice, is no bucket, and does not leave the item's task; the buckets are whole."""
    rnd = random.Random(5)
    items = [(i, [rnd.randrange(-2000, 2000) for _ in range(rnd.randrange(6))]) for i in range(400)] + [(900, [77_777, 77_777]), (901, [])]
    df = spark.createDataFrame(items, "id long, keys array<long>").repartition(3)
    scratch = Scratch(spark, "test-buckets")
    found = lsh.buckets(df, scratch)
    by = {}
    for i, keys in items:
        for k in keys:
            by.setdefault(k, set()).add(i)
    expected = {(k, i) for k, ids in by.items() if len(ids) > 1 for i in ids}
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert spark.read.parquet(scratch.path("shared-keys")).count() == len({k for k, _ in expected})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # keys are taken apart and sifted before the shuffle


def test_a_payload_bucketed_by_id_stays_where_it_is(spark):
    scratch = Scratch(spark, "test-bucketed")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        payload = scratch.keep_by(spark.range(500).selectExpr("id", "cast(cast(id as string) as binary) data"), "payload", "id")
        both = spark.range(1000).selectExpr("id * 2 as id", "id as other").join(payload, "id")
        assert both.count() == 250
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    table = scratch.tables["payload"]
    scratch.drop("payload")
    assert not spark.catalog.tableExists(table)


def test_pairs_of_unlike_sizes_move_no_payload(spark):
    scratch = Scratch(spark, "test-sizes")
    sizes = [0, 1, 4, 5, 20, 25, 26, 80, 100, 101, 1000]
    payload = scratch.keep(spark.createDataFrame([(n, bytes(4 * n)) for n in sizes], "id long, data binary"), "payload")
    pairs = [(a, b) for a in sizes for b in sizes if a < b]
    kept = lsh.sized_alike(spark.createDataFrame(pairs, "a long, b long"), payload, lsh.shared_of_larger(0.8))
    assert {tuple(r) for r in kept.collect()} == {(a, b) for a, b in pairs if a >= 0.8 * b - 1e-6}
    union = lsh.sized_alike(spark.createDataFrame(pairs, "a long, b long"), payload, lsh.shared_of_union(0.8))
    assert {tuple(r) for r in union.collect()} == {(a, b) for a, b in pairs if a >= 0.8 * b - 1e-6}


def test_rare_rows_are_shuffled_once(spark):
    """Items with repeated words, some of them out: every pair that is like is met, and each token's row moves once."""
    rnd = random.Random(17)
    texts = []
    for k in range(12):
        base = [rnd.randrange(60) for _ in range(60)]
        for _ in range(5):
            text = list(base)
            for at in rnd.sample(range(60), 4):
                text[at] = rnd.randrange(60)
            texts.append(text)
    data = [(i, np.array(t, np.uint32).tobytes()) for i, t in enumerate(texts)]
    out = [i % 3 != 0 for i in range(len(texts))]
    scratch = Scratch(spark, "test-rare")
    payload = scratch.keep(spark.createDataFrame(data, "id long, data binary"), "payload")
    left = spark.createDataFrame([(i, i, out[i], [1]) for i in range(len(texts))], "id long, root long, out boolean, keys array<long>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, _ = lsh.rare_pairs(left, payload, 0.8, scratch)
        rows = [frozenset((r["a"], r["b"])) for r in pairs.collect()]
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    share = lambda x, y: sum((Counter(x) & Counter(y)).values())
    like = {frozenset((a, b)) for a in range(len(texts)) for b in range(a) if (out[a] or out[b]) and share(texts[a], texts[b]) >= 0.8 * 60}
    assert len(rows) == len(set(rows)) and like and like <= set(rows)
    assert not any(not out[a] and not out[b] for a, b in map(tuple, rows))
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_members_with_sizes_pair_without_a_join_of_sizes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(0, 40, size=int(n)).astype(np.uint32).tobytes(), [7 + i % 3, 100 + i // 2])
            for i, n in enumerate(rng.integers(1, 30, 60))]
    payload = spark.createDataFrame([(i, d) for i, d, _ in rows], "id long, data binary")
    found = []
    for size in (True, False):
        scratch = Scratch(spark, "sizes")
        items = spark.createDataFrame([(i, k, len(d) // 4) for i, d, k in rows], "id long, keys array<long>, size int")
        items = items if size else items.drop("size")
        members = scratch.keep(lsh.buckets(items, scratch), "members")
        assert ("size" in members.columns) == size
        if size:
            monkeypatch.setattr(lsh, "sized_alike", None)
        links, roots = lsh.links(items, members, scratch.keep(payload, "payload"), lambda a, b: float(abs(len(a) - len(b)) <= 8), 0.8, scratch)
        found.append((sorted(map(tuple, roots.distinct().collect())), sorted((r["a"], r["b"]) for r in links.collect())))
        monkeypatch.undo()
    assert found[0] == found[1] and found[0][1]
