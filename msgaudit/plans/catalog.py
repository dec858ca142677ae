"""Registered queries: every operator of the blueprint as a job over the
driver's tables.  Each entry takes ``(spark, sf_dir)`` and returns a DataFrame
whose column names match the SQL oracle in ``oracle.py``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as X
from ..functions.lexicon import keyword_hit
from ..operators import rank as K
from ..operators import stats as A
from ..functions import timestamps as T
from ..functions.coerce import falsy_to_empty, fill_defaults, to_numeric, truncate_int
from ..operators import columns as C
from ..operators import dataset as M
from ..operators.detect import detection_counts, hybrid_label, label_table_scorer
from ..session import spread, table_path
from .tables import (event_log, labelled_sources, noisy_conversations, platforms, read,
                     scored_messages)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOP_N = 25  # fixed value: report top-N per platform


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- detection and statistics -----------------------------------------------------

@query("hybrid_label")
def q_hybrid_label(spark, sf):
    s = scored_messages(spark, sf)
    return s.select("doc_id", "platform", "keyword_hit", "predicted_label", "confidence")


@query("platform_stats")
def q_platform_stats(spark, sf):
    return A.platform_stats(scored_messages(spark, sf), "platform")


@query("detect_counts")
def q_detect_counts(spark, sf):
    return detection_counts(scored_messages(spark, sf), ["platform"])


@query("overall_rollup")
def q_overall_rollup(spark, sf):
    return A.overall_rollup(scored_messages(spark, sf), "platform")


@query("summary_table")
def q_summary_table(spark, sf):
    stats = A.stats_for_dimension(scored_messages(spark, sf), platforms(spark, sf), "platform")
    return A.summary_strings(stats).select("platform", "total", "hate_cell", "safe_cell",
                                           "hate_pct_cell", "safe_pct_cell")


#: A report's fixed platforms for ``summary_fixed``; the last has no messages.
FIXED_PLATFORMS = ["src0", "src1", "src2", "Messenger"]


@query("summary_fixed")
def q_summary_fixed(spark, sf):
    """R2 over a fixed list of platforms: one without messages is a row of zeros, others are left out."""
    from .report import report_platforms, summary_table

    return summary_table(scored_messages(spark, sf), report_platforms(spark, FIXED_PLATFORMS)).select(
        "platform", "total", "hate_cell", "safe_cell", "hate_pct_cell", "safe_pct_cell")


@query("chart_series")
def q_chart_series(spark, sf):
    return A.chart_series(A.overall_rollup(scored_messages(spark, sf), "platform"), "platform")


# --- ranked listings ---------------------------------------------------------------

@query("flagged_topn")
def q_flagged_topn(spark, sf):
    flagged = scored_messages(spark, sf).filter(F.col("predicted_label") == 1)
    top = K.top_n(flagged, TOP_N, [F.desc("confidence"), F.asc("doc_id")], barrier=True)
    w = Window.orderBy(F.desc("confidence"), F.asc("doc_id"))  # over the n kept rows only
    top = X.with_report_clean_twice(top, "text", "listing_text")
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "doc_id", "platform",
                      X.confidence_percent(F.col("confidence")).alias("confidence_cell"),
                      X.reduce_code_blobs(F.col("listing_text")).alias("listing_text"))


@query("flagged_topn_platform")
def q_flagged_topn_platform(spark, sf):
    flagged = scored_messages(spark, sf).filter(F.col("predicted_label") == 1)
    top = K.top_n_per_group(flagged, ["platform"], [F.desc("confidence"), F.asc("doc_id")], TOP_N)
    return top.select("platform", "rank", "doc_id", "confidence",
                      X.confidence_percent(F.col("confidence")).alias("confidence_cell"))


@query("longest_texts")
def q_longest_texts(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", F.length("text").cast("long").alias("text_length"))
    top = K.top_n(docs, TOP_N, [F.desc("text_length"), F.asc("doc_id")])
    w = Window.orderBy(F.desc("text_length"), F.asc("doc_id"))
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "doc_id", "source", "text_length")


@query("all_texts")
def q_all_texts(spark, sf):
    """Every message of the file scan, numbered in source order before its label is joined."""
    from .evidence import EPOCH_MS_BASE, MS_PER_DOC
    from .report import all_texts_listing

    placed = K.with_position(spark.read.parquet(table_path(sf, "documents")))
    docs = placed.select(
        "doc_id", F.col("source").alias("platform"), "text", "path", "row_id",
        (F.lit(EPOCH_MS_BASE) + F.col("doc_id") * MS_PER_DOC).cast("string").alias("created_at"),
        F.concat("source", F.lit("_data/a-b.db")).alias("source_database"), F.lit("messages_1").alias("source_table"))
    numbered = K.number_in_source_order(docs, ["platform"], ["path"])
    scored = hybrid_label(numbered, label_table_scorer(read(spark, sf, "labels"), "doc_id"))
    return all_texts_listing(scored, keep=["doc_id"])


@query("flagged_listing")
def q_flagged_listing(spark, sf):
    from .evidence import EPOCH_MS_BASE, MS_PER_DOC
    from .report import flagged_listing

    s = scored_messages(spark, sf)
    pred = s.select("doc_id", "platform", "predicted_label", "confidence", "text",
                    (F.lit(EPOCH_MS_BASE) + F.col("doc_id") * MS_PER_DOC).cast("string").alias("created_at"),
                    F.concat("platform", F.lit("_data/a-b.db")).alias("source_database"),
                    F.lit("messages_1").alias("source_table"))
    return flagged_listing(pred, TOP_N, ["doc_id"])


# --- scalar text operators -------------------------------------------------------------

@query("model_clean")
def q_model_clean(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.model_clean(F.col("text")).alias("clean_text"))


@query("keyword_flag")
def q_keyword_flag(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("documents").alias("source_table"),
                                            F.col("doc_id").alias("row_id"), F.lit(None).cast("long").alias("turn"),
                                            "text")
    c = read(spark, sf, "conversations").select(F.lit("conversations").alias("source_table"),
                                                F.col("conv_id").alias("row_id"), "turn", "text")
    u = d.unionByName(c)
    return u.select("source_table", "row_id", "turn", keyword_hit(F.col("text")).alias("keyword_hit"))


@query("content_hash")
def q_content_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256_hash"))


@query("text_combine")
def q_text_combine(spark, sf):
    d = read(spark, sf, "documents").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_id"),
        F.lit(None).cast("long").alias("turn"), X.combine_text(["text", "lang", "source"]).alias("combined"))
    c = read(spark, sf, "conversations").select(
        F.lit("conversations").alias("source_table"), F.col("conv_id").alias("row_id"), "turn",
        X.combine_text(["role", "text"]).alias("combined"))
    return d.unionByName(c).filter(F.col("combined") != "")


@query("strip_emojis")
def q_strip_emojis(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.strip_emojis("text").alias("stripped"))


@query("control_chars")
def q_control_chars(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.control_to_space(F.col("html")).alias("spaced"))


@query("sanitize_text")
def q_sanitize_text(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("documents").alias("source_table"),
                                                    F.col("doc_id").alias("row_id"),
                                                    X.sanitize_text("text").alias("sanitized"))
    p = read(spark, sf, "pages").select(F.lit("pages").alias("source_table"), F.col("page_id").alias("row_id"),
                                                X.sanitize_text("html").alias("sanitized"))
    return d.unionByName(p)


@query("prefix_noise")
def q_prefix_noise(spark, sf):
    return noisy_conversations(spark, sf).select("conv_id", "turn", X.strip_prefix_noise(F.col("noisy")).alias("result"))


@query("suffix_noise")
def q_suffix_noise(spark, sf):
    return noisy_conversations(spark, sf).select("conv_id", "turn", X.strip_suffix_noise(F.col("noisy")).alias("result"))


@query("report_clean")
def q_report_clean(spark, sf):
    n = noisy_conversations(spark, sf)
    return n.select("conv_id", "turn", X.report_clean(F.col("noisy")).alias("result"))


@query("bytes_literal")
def q_bytes_literal(spark, sf):
    from .tables import dealt

    d = dealt(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    hexed = F.concat(F.lit("b'"), F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "\\\\x$1"), F.lit("'"))
    mismatched = F.concat(F.lit('b"'), F.col("text"), F.lit("'"))
    a = d.select("doc_id", F.lit("hex").alias("variant"), hexed.alias("payload"))
    b = d.select("doc_id", F.lit("fallback").alias("variant"), mismatched.alias("payload"))
    u = a.unionByName(b)
    return u.select("doc_id", "variant", X.bytes_literal_to_text(F.col("payload"), gated=False).alias("decoded"))


@query("soft_wrap")
def q_soft_wrap(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.soft_wrap("url").alias("wrapped"))


@query("code_blobs")
def q_code_blobs(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_id"),
                                            X.reduce_code_blobs("text").alias("reduced"))
    p = read(spark, sf, "pages").select(F.lit("pages").alias("source_table"), F.col("page_id").alias("row_id"),
                                        X.reduce_code_blobs("html").alias("reduced"))
    return d.unionByName(p)


@query("handle_normalise")
def q_handle_normalise(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.normalise_handle(F.col("url")).alias("handle"))


@query("name_from_path")
def q_name_from_path(spark, sf):
    p = read(spark, sf, "pages")
    path = F.concat(F.regexp_replace("url", r"[?#][\s\S]*", ""), F.lit(".db"))
    return p.select("page_id", X.name_from_path(path).alias("name"))


# --- dates ---------------------------------------------------------------------------

def _epoch_strings(e):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", "ts", us.alias("us"), secs.cast("string").alias("s_str"),
                    F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ms_str"), us.cast("string").alias("us_str"),
                    F.concat(secs.cast("string"), F.lit("."),
                             F.lpad(F.pmod(us, F.lit(1000000)).cast("string"), 6, "0")).alias("frac_str"))


@query("epoch_parse")
def q_epoch_parse(spark, sf):
    e = _epoch_strings(spread(read(spark, sf, "events")))
    fmt = lambda c: F.date_format(T.epoch_to_date(to_numeric(F.col(c))), "yyyy-MM-dd")
    return e.select("event_id", fmt("s_str").alias("d_s"), fmt("ms_str").alias("d_ms"),
                    fmt("us_str").alias("d_us"), fmt("frac_str").alias("d_frac"))


@query("first_datetime")
def q_first_datetime(spark, sf):
    e = _epoch_strings(read(spark, sf, "events"))
    k = F.pmod(F.col("event_id"), F.lit(8))
    opts = [F.col("ms_str"), F.col("s_str"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.date_format("ts", "MM/dd/yyyy"), F.date_format("ts", "dd/MM/yyyy"), F.lit("0"), F.lit("None"),
            F.date_format("ts", "MMM d, yyyy")]
    sent = None
    for i, o in enumerate(opts):
        sent = F.when(k == i, o) if sent is None else sent.when(k == i, o)
    d = spread(e).select("event_id", sent.alias("sent"), F.date_format("ts", "yyyyMMdd").alias("received"))
    return T.with_nice_date(d, "date_time", ["sent", "received"]).select("event_id", "sent", "date_time")


#: Renderings of a time stamp that the date parser understands; of a month only; and two that are no dates.
DATE_RENDERINGS = ["dd-MMM-yyyy", "EEE, dd MMM yyyy HH:mm:ss '+0000'", "yyyy.MM.dd", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd hh:mm a",
                   "MMMM d, yyyy", "EEE MMM d HH:mm:ss yyyy", "d MMMM yyyy HH:mm", "yyyy-MM-dd HH:mm:ss 'UTC'", "MMM d, yyyy h:mm:ss a",
                   "yyyyMMdd HHmmss", "yyyyMMddHHmmss", "MM-dd-yy", "MM/dd/yy", "yyyy MMM dd", "yyyy-MMM-dd", "HH:mm MM/dd/yyyy",
                   "yyyy-MM-dd'T'HH", "yyyy-MM-dd HH", "d'th' MMMM yyyy", "MMMM d'th', yyyy", "dd-MMM-yy",
                   "yyyy-MM-dd HH:mm:ss 'EST'", "yyyy-MM-dd HH:mm:ss'+5'",
                   "MMM yyyy", "MMMM yyyy", "yyyy.MM", "MM/yyyy", "yyyy-MM-dd 99:99", "MMM'xxxx' d, yyyy"]


@query("date_shapes")
def q_date_shapes(spark, sf):
    e = spread(read(spark, sf, "events"))
    k = F.pmod(F.col("event_id"), F.lit(len(DATE_RENDERINGS)))
    shown = None
    for i, pattern in enumerate(DATE_RENDERINGS):
        text = F.date_format("ts", pattern)
        shown = F.when(k == i, text) if shown is None else shown.when(k == i, text)
    return T.with_nice_date(e.select("event_id", shown.alias("sent")), "date_time", ["sent"]).select("event_id", "date_time")


@query("msg_datetime")
def q_msg_datetime(spark, sf):
    o = read(spark, sf, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(3))
    created = (F.when(k == 0, F.lit("-")).when(k == 1, F.date_format("o_orderdate", "dd MMM yyyy"))
                .otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")))
    d = spread(o).select("o_orderkey", created.alias("created_at"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("date"))
    return T.with_message_date(d, "msg_date").select("o_orderkey", "msg_date")


@query("date_time_combo")
def q_date_time_combo(spark, sf):
    o = read(spark, sf, "orders")
    day = F.when(F.pmod(F.col("o_orderkey"), F.lit(2)) == 0, F.date_format("o_orderdate", "yyyy-MM-dd")) \
           .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    d = spread(o).select("o_orderkey", day.alias("date"), F.date_format("o_orderdate", "HH:mm:ss").alias("time"))
    d = T.with_first_date(d, "combo_date", [], combo=("date", "time"), fmt="yyyy-MM-dd", missing="-")
    return d.select("o_orderkey", "combo_date")


# --- coercion and defaults --------------------------------------------------------------

@query("coerce_numeric")
def q_coerce_numeric(spark, sf):
    e = read(spark, sf, "events")
    k = F.regexp_extract("props", '"k": ([^}]*)', 1)
    m = F.pmod(F.col("event_id"), F.lit(6))
    raw = (F.when(m == 0, F.concat(k, F.lit("x"))).when(m == 1, F.concat(F.lit(" "), k, F.lit(" ")))
            .when(m == 2, F.concat(k, F.lit(".75"))).when(m == 3, F.concat(F.lit("-"), k, F.lit("e1")))
            .when(m == 4, F.concat(k, F.lit("d"))).otherwise(k))
    d = e.select("event_id", raw.alias("raw"))
    num = to_numeric(F.col("raw"))
    return d.select("event_id", "raw", num.alias("num"), truncate_int(num).alias("int_val"))


@query("fill_defaults")
def q_fill_defaults(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    j = d.join(read(spark, sf, "labels"), "doc_id", "left")
    pred = j.select("doc_id", F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
                    F.col("toxic").cast("string").alias("predicted_label"),
                    F.when(F.col("toxic").isNull(), F.lit(None)).otherwise(F.col("quality").cast("double"))
                     .alias("confidence"),
                    F.col("source").alias("source_database"), F.col("lang").alias("source_table"))
    f = fill_defaults(pred)
    return f.select("doc_id", F.length("text").cast("long").alias("text_len"), "predicted_label", "confidence",
                    "source_database", "source_table")


# --- columns, union, flattening ------------------------------------------------------------

def _evidence_tables(spark, sf):
    # read as they lie: flattening does too little to a text for dealing the rows out to pay
    names = ["documents", "conversations", "benchmark", "pages", "orders"]
    out = [C.EvidenceTable(spark.read.parquet(table_path(sf, n)), f"{n}.parquet", n) for n in names]
    out.append(C.EvidenceTable(event_log(spark, sf), "events.parquet", "event_log"))
    return out


@query("role_projection")
def q_role_projection(spark, sf):
    t = C.extract_table(C.EvidenceTable(read(spark, sf, "orders"), "orders.parquet", "orders"))
    return t.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("union_by_name")
def q_union_by_name(spark, sf):
    return C.union_by_name([read(spark, sf, n) for n in ("documents", "conversations", "benchmark")])


def _mixed_tables(spark, sf):
    """The same columns with other types: text, numbers and truth values."""
    d, c, l = (read(spark, sf, n) for n in ("documents", "conversations", "labels"))
    return [d.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("n_chars").alias("size"),
                     F.lit(None).alias("flag")),
            c.select(F.col("conv_id").alias("id"), F.col("turn").alias("body"), (F.col("turn") / F.lit(2.0)).alias("size"),
                     (F.col("turn") % 2 == 0).alias("flag")),
            l.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("body"), F.col("toxic").alias("size"),
                     F.col("quality").alias("flag"))]


@query("union_mixed_types")
def q_union_mixed_types(spark, sf):
    """U1 where a name has another type in every table."""
    return C.union_by_name(_mixed_tables(spark, sf))


@query("flatten_mixed_types")
def q_flatten_mixed_types(spark, sf):
    """M1 over tables of which one holds text, others numbers and truth values under the same name."""
    names = ["documents", "conversations", "labels"]
    return C.flatten_tables([C.extract_table(C.EvidenceTable(t.select("body", "size"), f"{n}.parquet", n))
                             for n, t in zip(names, _mixed_tables(spark, sf))])


@query("extract_flatten")
def q_extract_flatten(spark, sf):
    return C.flatten_tables([C.extract_table(t) for t in _evidence_tables(spark, sf)])


@query("flatten_numeric")
def q_flatten_numeric(spark, sf):
    """Text-like names over numbers and booleans: only ``body`` is text."""
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("message_no"), F.col("text").alias("body"),
                                            (F.col("doc_id") % 2 == 0).cast("string").alias("comment_flag"))
    return C.flatten_tables([C.extract_table(C.EvidenceTable(d, "documents.parquet", "documents"))])


@query("string_fallback")
def q_string_fallback(spark, sf):
    """No text-like name: every string column that holds text takes part."""
    d = read(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("k"), "source")
    return C.flatten_tables([C.extract_table(C.EvidenceTable(d, "documents.parquet", "documents"))])


@query("first_present_column")
def q_first_present_column(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("database"),
                                            F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    db_col = C.first_present(d.columns, ["database_file", "file", "database", "db"], 0)
    hash_col = C.first_present(d.columns, ["sha256_hash", "sha256", "hash", "sha_256"], 1)
    return d.select("doc_id", X.soft_wrap(db_col).alias("database_cell"), X.soft_wrap(hash_col).alias("hash_cell"))


# --- labelled dataset --------------------------------------------------------------------

def _merged(spark, sf):
    s1, s2, s3 = labelled_sources(spark, sf)
    return M.merge_labelled([M.from_verdicts(s1, keep=["doc_id"]), M.from_numeric_labels(s2, keep=["doc_id"]),
                             M.from_numeric_labels(s3, keep=["doc_id"])])


@query("label_merge")
def q_label_merge(spark, sf):
    return _merged(spark, sf).select("doc_id", "text", "label")


@query("class_balance")
def q_class_balance(spark, sf):
    """Counts by label with their place in the order, most frequent first."""
    counts = A.class_balance(_merged(spark, sf), "label")
    w = Window.orderBy(F.desc("count"), F.asc("label"))  # over one row per label
    return counts.withColumn("place", F.row_number().over(w).cast("long"))


@query("split_exact")
def q_split_exact(spark, sf):
    """M4 with exactly ceil(0.2 n) validation rows."""
    return M.assign_exact_fold(_merged(spark, sf).select("doc_id", "text", "label"), "text", "doc_id").select("doc_id", "label", "fold")


@query("split")
def q_split(spark, sf):
    return M.assign_fold(_merged(spark, sf), "text").select("doc_id", "label", "fold")


@query("accuracy")
def q_accuracy(spark, sf):
    f = M.assign_fold(_merged(spark, sf), "text")
    f = f.withColumn("pred", keyword_hit(F.col("text")).cast("int"))
    return A.accuracy(f, "pred", "label", ["fold"])


# --- modes and handles ---------------------------------------------------------------------

@query("mode_nonempty")
def q_mode_nonempty(spark, sf):
    parts = [(read(spark, sf, "conversations"), "role"), (read(spark, sf, "documents"), "lang"),
             (read(spark, sf, "events"), "event_type")]
    out = None
    for df, col in parts:
        m = A.mode_nonempty(df, [col])
        out = m if out is None else out.unionByName(m)
    return out.select(F.col("column").alias("column_name"), "value", "n")


from .report import HANDLE_CANDIDATES  # noqa: E402


def _handles(spark, sf):
    d = read(spark, sf, "documents")
    frame = d.select(F.col("source").alias("platform"),
                     F.when(F.col("lang") == "de", F.concat(F.lit("@"), F.col("lang"))).otherwise(F.lit(""))
                      .alias("username"),
                     F.col("lang").alias("author"))
    m = A.first_candidate_mode(frame, HANDLE_CANDIDATES, ["platform"])
    return m.select("platform", F.col("column").alias("column_name"), X.normalise_handle(F.col("value")).alias("handle"))


@query("infer_handle")
def q_infer_handle(spark, sf):
    return _handles(spark, sf)


@query("handle_from_path")
def q_handle_from_path(spark, sf):
    """A7 with its fallback: the account's name from the database's path (X14) where no candidate column has a value."""
    from .report import infer_handles

    d = read(spark, sf, "documents")
    named = (F.col("lang") == "de") & (F.col("source") < "src2")
    frame = d.select(F.col("source").alias("platform"), F.when(named, F.lit("@de")).otherwise(F.lit(" ")).alias("username"),
                     F.concat(F.lit("/evidence/"), "source", F.lit("_"), "lang", F.lit(".db")).alias("source_database"),
                     F.col("doc_id").alias("row_id"))
    return infer_handles(frame).select("platform", "handle")


@query("infer_device")
def q_infer_device(spark, sf):
    from .report import infer_device

    frames = [read(spark, sf, "documents").select(F.lit(" ").alias("device_model"), F.col("lang").alias("device")),
              read(spark, sf, "events").select(F.col("event_type").alias("model"))]
    return infer_device(frames).select(F.col("column").alias("column_name"), "value")


@query("platform_summary")
def q_platform_summary(spark, sf):
    stats = A.platform_stats(scored_messages(spark, sf), "platform")
    return stats.join(_handles(spark, sf).select("platform", "handle"), "platform", "left")


# --- evidence files: fingerprints, archives, SQLite databases ---------------------------

@query("binary_hash")
def q_binary_hash(spark, sf):
    from ..sources.files import hash_inventory, scan_files
    from .evidence import build_databases

    root, _ = build_databases(spark, sf)
    return hash_inventory(scan_files(spark, root)).select("database_file", "sha256_hash", "platform", "length")


@query("tar_members")
def q_tar_members(spark, sf):
    from ..sources.archive import database_listing, list_archives
    from ..sources.files import basename
    from .evidence import STREAM_BYTES, build_archives, build_databases

    _, written = build_databases(spark, sf)
    tars = build_archives(spark, written)
    listing = database_listing(list_archives(spark, tars, row_bytes=STREAM_BYTES))
    # The reference's listing is the sorted member names of each archive.
    return listing.select(basename(F.col("archive")).alias("archive"), "member")


@query("member_hash")
def q_member_hash(spark, sf):
    from ..sources.archive import list_archives, member_hashes
    from .evidence import STREAM_BYTES, build_text_archives

    found = member_hashes(list_archives(spark, build_text_archives(spark, sf), row_bytes=STREAM_BYTES))
    return found.select("member", "length", "sha256_hash", "error")


@query("sqlite_scan")
def q_sqlite_scan(spark, sf):
    from ..sources.files import scan_files
    from ..sources.sqlite import scan_databases
    from .evidence import build_databases

    root, _ = build_databases(spark, sf)
    scan = scan_databases(scan_files(spark, root))
    return scan.filter(F.col("kind") == "catalog").select("source_database", "source_table", "n_rows")


@query("parse_all")
def q_parse_all(spark, sf):
    from ..sources.sqlite import parse_all
    from .evidence import build_databases

    root, _ = build_databases(spark, sf)
    return parse_all(spark, root).select("text", "date_time", "source_database", "source_table")


@query("archive_parse")
def q_archive_parse(spark, sf):
    from ..sources.archive import list_archives, members_as_files, tar_members
    from ..sources.sqlite import flatten_scan, scan_databases
    from .evidence import STREAM_BYTES, build_archives, build_databases

    _, written = build_databases(spark, sf)
    tars = build_archives(spark, written)
    members = members_as_files(tar_members(list_archives(spark, tars, row_bytes=STREAM_BYTES)))
    flat = flatten_scan(scan_databases(members))
    return flat.select("text", "date_time", "source_database", "source_table")


# --- CSV round trip and the report's reload ------------------------------------------------

@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources.csv import write_csv
    from .report import load_predictions

    pred = scored_messages(spark, sf).select(
        "text", "predicted_label", "confidence", F.lit("-").alias("date_time"),
        F.col("platform").alias("source_database"), F.lit("documents").alias("source_table"))
    path = scratch_path(spark, "predictions-csv")
    write_csv(pred, path)
    return load_predictions(spark, path)


@query("platform_sink")
def q_platform_sink(spark, sf):
    """Predictions written by platform twice (the second run replaces what the first wrote), then read for two platforms."""
    from ..session import scratch_path
    from ..sources.sink import read_by_platform, write_by_platform

    pred = scored_messages(spark, sf).select("doc_id", "platform", "predicted_label", "confidence")
    path = scratch_path(spark, "predictions")
    write_by_platform(pred.withColumn("confidence", F.lit(-1.0)), path)
    write_by_platform(pred, path)
    return read_by_platform(spark, path, pred.schema, FIXED_PLATFORMS[2:])


@query("missing_source")
def q_missing_source(spark, sf):
    """S3: a source that does not exist counts no rows beside one that does."""
    from ..sources.csv import read_csv
    from .report import PREDICTION_SCHEMA

    absent = read_csv(spark, f"{sf}/no-such-predictions.csv", PREDICTION_SCHEMA)
    rows = absent.select(F.lit("absent").alias("source")).unionByName(read(spark, sf, "documents").select(F.lit("documents").alias("source")))
    names = spark.createDataFrame([("absent",), ("documents",)], "source string")
    return names.join(rows.groupBy("source").count(), "source", "left").select(
        "source", F.coalesce("count", F.lit(0)).alias("total"))


@query("falsy_to_empty")
def q_falsy_to_empty(spark, sf):
    """D7 over text, numbers and truth values."""
    c = read(spark, sf, "conversations")
    blank = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.col("role"))
    return c.select("conv_id", "turn", falsy_to_empty(blank).alias("role_cell"), falsy_to_empty("turn", c.schema["turn"].dataType).alias("turn_cell"),
                    falsy_to_empty(F.col("turn") > 1, BooleanType()).alias("later_cell"))


@query("report_dates")
def q_report_dates(spark, sf):
    """``DD/MM/YYYY`` or ``-`` of a date, and of text the date or else the text itself."""
    o = read(spark, sf, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(3))
    day = F.when(k != 0, F.col("o_orderdate").cast("date"))
    text = F.when(k == 0, F.lit("soon")).when(k == 1, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", T.format_report_date(day).alias("date_cell"), T.nice_datetime(text).alias("text_cell"))


@query("hash_appendix")
def q_hash_appendix(spark, sf):
    """R7 over the inventory of the table files themselves: every file's name and SHA-256."""
    from ..sources.files import hash_inventory, scan_files
    from .report import hash_appendix

    return hash_appendix(hash_inventory(scan_files(spark, sf, "*.parquet")).select("database_file", "sha256_hash"))


# --- training and scoring -------------------------------------------------------------------

@query("train_score")
def q_train_score(spark, sf):
    from ..operators import train as ML
    from ..operators.detect import hybrid_label
    from ..session import scratch_path
    from .tables import dealt, messages

    data = ML.prepare(M.assign_fold(_merged(spark, sf), "text"))
    fitted = ML.fit_select(data.filter(F.col("fold") == "train"), data.filter(F.col("fold") == "validation"))
    path = scratch_path(spark, "model")
    ML.save(fitted.model, path)
    scorer = ML.model_scorer(ML.load(path))
    pred = hybrid_label(dealt(messages(spark, sf), "doc_id", "text"), scorer)
    return pred.select("doc_id", "platform", "keyword_hit", "predicted_label", "confidence")


def _exact_folds(spark, sf):
    folded = M.assign_exact_fold(_merged(spark, sf).select("doc_id", "text", "label"), "text", "doc_id")
    return folded.filter(F.col("fold") == "train"), folded.filter(F.col("fold") == "validation")


@query("network_score")
def q_network_score(spark, sf):
    """M7 and M8: a network trained in epochs, the best of them as scorer of the messages without a hit."""
    from ..operators.network import network_scorer, train_epochs
    from .tables import dealt, messages

    trained = train_epochs(*_exact_folds(spark, sf))
    pred = hybrid_label(dealt(messages(spark, sf), "doc_id", "text"), network_scorer(spark, trained.net.to_bytes()), python_scorer=True)
    return pred.select("doc_id", "platform", "keyword_hit", "predicted_label", "confidence")


RELATIONAL_STEPS = 3


@query("score_relational")
def q_score_relational(spark, sf):
    """M5, M6, M8, M9: the linear model fitted, written and applied as tables."""
    from ..operators import relational as R
    from ..session import scratch_path

    path = scratch_path(spark, "linear-model")
    R.save(R.fit(_exact_folds(spark, sf)[0], steps=RELATIONAL_STEPS), path)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    out = R.margins(R.load(spark, path), docs, "doc_id")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return out.select("doc_id", F.round("margin", 6).alias("margin"), (F.col("margin") > 0).cast("int").alias("model_label"),
                      F.round(F.greatest(p, 1.0 - p), 6).alias("model_confidence"))
