"""The pipeline and its stages against plain Python."""
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np

import __spark_entry__ as E
import corpus_pipeline
from msgaudit.llm import mixing, near_dup, queries, toxicity

from .helpers import SF, documents, small, words


def test_every_operator_has_a_query():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        rel = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(rel.columns)
        rnd = lambda v: round(v, 6) if isinstance(v, float) else v
        a = sorted(tuple(rnd(r[c]) for c in cols) for r in got.collect())
        b = sorted(tuple(rnd(v) for v in r) for r in rel.select(*cols).fetchall())
        assert a == b, name


CONTRACT = {
    "op1": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3": "doc_id bigint, class_id bigint",
    "op4": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7": "doc_id bigint, start bigint, end bigint, removed boolean, first_doc_id bigint",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op12": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
            "repaired_sha256 string"}


def test_query_columns(spark):
    for name, query in queries.QUERIES.items():
        got = dict(query(spark, SF).dtypes)
        want = dict(c.split() for c in CONTRACT[name.split("_")[0]].split(", "))
        assert {c: got.get(c) for c in want} == want, name


def test_stages_against_plain_python(spark):
    rnd = random.Random(8)
    rows = [(d["doc_id"], d["text"], d["source"]) for d in documents()[:60]]
    rows += [(200 + k, rows[k][1].upper(), rows[k][2]) for k in range(5)]
    near = words(rnd, 80, 9999).split()
    rows.append((300, " ".join(near), "s1"))
    near[40] = "changed"
    rows.append((301, " ".join(near), "s2"))
    df = small(spark, rows)

    exact = corpus_pipeline.drop_exact_copies(spark, df, SF).collect()
    best = {}
    for i, t, _ in rows:
        key = near_dup.normalise(t)
        best[key] = max(best.get(key, -1), i)
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())

    kept_rows = [(r["doc_id"], r["text"], r["source"]) for r in exact]
    out = corpus_pipeline.drop_near_copies(spark, small(spark, kept_rows), SF).collect()
    hasher = near_dup.WordHasher()
    packed = {i: hasher(near_dup.normalise(t).split()) for i, t, _ in kept_rows}
    root = {i: i for i in packed}
    for _ in packed:  # smallest id that can be reached over links
        for a in packed:
            for b in packed:
                if a < b and root[a] != root[b] and near_dup.likeness(packed[a].tobytes(), packed[b].tobytes()) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
        break
    ids = {r["doc_id"] for r in out}
    assert 300 in ids and 301 not in ids and ids == {i for i in root if root[i] == i}

    stay = [(r["doc_id"], r["text"], r["source"]) for r in out]
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, small(spark, stay), SF).collect())
    copies = {r["id"]: r["copies"] for r in mixing.mix(small(spark, stay)).collect()}
    assert mixed == Counter({i: c for i, c in copies.items() if c})
    pieces = corpus_pipeline.pack_sequences(spark, small(spark, stay), SF).collect()
    full = defaultdict(int)
    for p in pieces:
        full[p["sequence_id"]] += p["length"]
    assert {p["doc_id"] for p in pieces} == {i for i, *_ in stay} and max(full.values()) <= 2048


def test_toxic_stage_keeps_what_scores_low(spark):
    docs = documents()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.train(df, labels)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, df, SF).collect()}
    score = toxicity.Scorer(net)([d["text"] for d in docs])
    sure = {d["doc_id"] for d, s in zip(docs, score) if s < 0.29}
    assert sure <= kept and not kept & {d["doc_id"] for d, s in zip(docs, score) if s > 0.31}
    assert np.mean([s < 0.3 for s in score]) > 0.5
