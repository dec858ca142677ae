"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, iblt, licences, lm, mixing, near_dup, negatives, packing, pii, sharding, substring, toxicity
from .common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    out = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), every_digest=True)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    out = iblt.fingerprints(read(spark, sf_dir, "documents"))
    return out.drop("lost", "gained").withColumnRenamed("id", "doc_id")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and the number of its text's links that built the class."""
    out = near_dup.near_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))


# The level is found in one pass over the sources in the order in which they reach their limits.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS most,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM s),
o AS (SELECT *, coalesce(sum(most) OVER f, 0) AS before_most, sum(weight) OVER b AS open_weight,
             sum(source_size) OVER () AS total
      FROM w WINDOW f AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    b AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(arg_min((total - before_most)::DOUBLE / open_weight::DOUBLE, most::DOUBLE / weight)
                      FILTER (WHERE most >= (total - before_most)::DOUBLE / open_weight::DOUBLE * weight), 0) AS level FROM o),
t AS (SELECT w.source, source_size, least(most::DOUBLE, level * weight) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(sha256('42|' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS nth
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor((nth + 1) * rate + u) - floor(nth * rate + u)) * size)::BIGINT AS taken
FROM r
"""


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_char_lstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of every document: those to remove, and the first occurrences."""
    out = substring.merged_spans(substring.repeats(read(spark, sf_dir, "documents")))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("first_id", "first_doc_id")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log10 probability, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    return lm.train(docs).score(docs).withColumnRenamed("id", "doc_id")


def op9_toxic_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence phrases, labels and score."""
    out = licences.scan(read(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["exact"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
                      F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives in the window of each positive of every anchor."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation with its faults and its cheapest repair."""
    out = conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))
    return out.withColumnRenamed("conv", "conv_id")


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
             list_dot_product(a.v, c.v)::BIGINT AS score
      FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
            AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


# CRC-32 by its table; then rows one by one, the best way to each state (0 nothing yet, 1 after s, 2 after u, 3 after a).
OP13_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_concat([4294967295::UBIGINT],
                         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda x: ascii(x)::UBIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS damage
          FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM keyed WHERE damage <> 0),
placed AS (SELECT conv_id, turn, role, text, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
           FROM damaged),
rows_ AS (SELECT *, CASE WHEN solid = '' THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
                        WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
          FROM placed),
facts AS (SELECT conv_id, count(*) AS n,
                 CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
          FROM rows_ GROUP BY conv_id),
convs AS (SELECT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
                 coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
          FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id),
moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
                                      (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edits AS (SELECT p, p AS q, 'D' AS edit, 4 AS cost, NULL::VARCHAR AS initial FROM (SELECT unnest([0, 1, 2, 3]) AS p)
          UNION ALL SELECT p, q, 'R', 3, NULL FROM moves WHERE initial <> 's'
          UNION ALL SELECT p, q, 'K', 0, initial FROM moves),
steps AS MATERIALIZED (SELECT i.p, e.q, e.edit, e.initial, i.cost + e.cost AS cost, i.audit || e.edit AS audit
                       FROM inserts i JOIN edits e ON i.q = e.p),
ways(conv_id, n, state, cost, audit) AS (
    SELECT conv_id, 0::BIGINT, 0, 0, '' FROM convs
    UNION ALL
    SELECT conv_id, n, q, cost, audit
    FROM (SELECT w.conv_id, r.rn AS n, s.q, w.cost + s.cost + CASE WHEN r.fault = 'truncated' AND s.edit <> 'D' THEN 3 ELSE 0 END AS cost,
                 w.audit || s.audit AS audit
          FROM ways w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.n + 1
          JOIN steps s ON s.p = w.state AND (s.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
                      AND (s.initial IS NULL OR s.initial = left(r.role, 1)))
    QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
best AS (SELECT c.*, w.cost + i.cost AS cost, w.audit || i.audit AS audit
         FROM convs c JOIN ways w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n
         JOIN inserts i ON i.p = w.state AND i.q IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost + i.cost, w.audit || i.audit) = 1),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS place
            FROM best WHERE audit <> ''),
numbered AS (SELECT conv_id, edit, place, count(*) FILTER (edit <> 'I') OVER w AS rn, count(*) FILTER (edit <> 'D') OVER w - 1 AS nth,
                    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS system
             FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
texts AS (SELECT n.conv_id, string_agg(CASE WHEN edit = 'K' THEN r.role WHEN (nth - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
                                       || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY place) AS text
          FROM numbered n LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.rn = n.rn
          WHERE edit <> 'D' GROUP BY n.conv_id)
SELECT b.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit,
       sha256(coalesce(t.text, '')) AS repaired_sha256
FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_iblt_fingerprints": op2_iblt_fingerprints,
    "op3_order_minhash": op3_order_minhash,
    "op4_mix_sources": op4_mix_sources,
    "op5_pack": op5_pack,
    "op6_char_lstm_pii": op6_char_lstm_pii,
    "op7_paragraph_minhash": op7_paragraph_minhash,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_toxic_gru": op9_toxic_gru,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_licence_index": op11_licence_index,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op1_exact_dedup": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
