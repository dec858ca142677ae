"""DuckDB SQL oracle for every registered query.

Each statement restates the operator's semantics in plain SQL over the same
parquet tables (views ``documents``, ``labels``, ...).  Nothing but the word
list is shared with the Spark side: patterns and values are written out here,
so that a wrong constant there shows.  DuckDB's regex engine is RE2: no ``(?u)`` flag,
``(?i)`` is already Unicode-aware, replacement groups are ``\\1``.
"""

from __future__ import annotations

from ..functions.lexicon import lexicon


class X:
    """Patterns of the text rules, for RE2."""

    PY_SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    URL_PATTERN = "http[^" + PY_SPACE + "]+"
    MODEL_DROP_PATTERN = r"[^\p{L}\p{N}_අ-ෆාැෑුූිීෙේෛොෝෘෲෟාං ]+"
    EMOJI_CLASS = r"\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}"
    CONTROL_CLASS = r"\x00-\x08\x0B\x0C\x0E-\x1F"
    REPORT_KEEP_CLASS = r"\t\n\r -~\x{0D80}-\x{0DFF}\x{2000}-\x{206F}"
    PREFIX_NOISE = r"^[\s\S]*?((?:[\x{0D80}-\x{0DFF}]|[A-Za-z]{2})[\s\S]*)\z"
    NAME_FROM_PATH = r"(?i)[\\/]+([A-Za-z0-9._-]{3,})\.(?:db|sqlite3?)\n?\z"


class T:
    """Limits, placeholders and shapes of the date rules."""

    MS_MAX, S_MAX = 9223372036854.775, 9223372036.854774
    SKIP_VALUES = ["", "0", "None", "nan", "NaN"]
    SKIP_VALUES_REPORT = ["", "-", "0", "None", "nan", "NaN"]
    MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    TIME = r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
    ISO_YMD = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})" + TIME + r"\z"
    NUM_ABY = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})" + TIME + r"\z"
    COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"
    YEAR_ONLY = r"^([0-9]{4})\z"
    MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    MON_D_Y = r"(?i)^" + MON + r" ([0-9]{1,2}),? ([0-9]{4})\z"
    D_MON_Y = r"(?i)^([0-9]{1,2}) " + MON + r",? ([0-9]{4})\z"


class D:
    """What reads back as missing, and as a number."""

    NA_LITERALS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                   "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
    NUMERIC_PATTERN = r"^[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z"
    SPECIAL_FLOATS = r"^[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*[+-]?(?:inf|infinity|nan)[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z"


ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# --- SQL fragments -------------------------------------------------------------

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(e: str, pat: str, rep: str) -> str:
    return f"regexp_replace({e}, {lit(pat)}, {lit(rep)}, 'g')"


def model_clean(e: str) -> str:
    return f"lower(trim({rr(rr(e, X.URL_PATTERN, ''), X.MODEL_DROP_PATTERN, ' ')}))"


def kw_hit(e: str) -> str:
    n = f"nfc_normalize(lower({e}))"
    words = list(dict.fromkeys(lexicon("reference")))
    return "coalesce(" + " OR ".join(f"contains({n}, {lit(w)})" for w in words) + ", false)"


def strip_emojis(e: str) -> str:
    return rr(f"coalesce({e}, '')", "[" + X.EMOJI_CLASS + "]", "")


def ctrl(e: str) -> str:
    return rr(e, "[" + X.CONTROL_CLASS + "]", " ")


def py_strip(e: str) -> str:
    return rr(e, "^[" + X.PY_SPACE + "]+|[" + X.PY_SPACE + "]+\\z", "")


def sanitize(e: str) -> str:
    s = rr(ctrl(strip_emojis(e)), "[^" + X.REPORT_KEEP_CLASS + "]", "")
    return py_strip(rr(s, "[ \t]+", " "))


def prefix_noise(e: str) -> str:
    return rr(e, X.PREFIX_NOISE, "\\1")


def suffix_noise(e: str) -> str:
    s, blanks, gap = e, "[" + X.PY_SPACE + "]*", "[" + X.PY_SPACE + "]+"
    for pat in ["reverb_db", "local_?message_?pe", "direct\\.db" + gap + "messages", "fts\\.db" + gap + "messages", "crypto_db",
                "omnistore_", "enigma\\.db", "\\(\\(" + blanks + "0" + blanks + r"B[^\n]*\n?\z"]:
        s = rr(s, "(?i)" + blanks + pat + r"[\s\S]*", "")
    return s


def report_clean_plain(e: str) -> str:
    s = ctrl(strip_emojis(e))
    s = prefix_noise(s)
    s = rr(s, "[^" + X.REPORT_KEEP_CLASS + "]", "")
    s = suffix_noise(s)
    s = f"replace({s}, '_', ' ')"
    s = rr(s, "[ \t]+", " ")
    return rr(s, "^[ \n\r\t]+|[ \n\r\t]+\\z", "")


def report_clean(e: str) -> str:
    # Inputs here never hold bytes literals (checked by the bytes_literal query).
    return report_clean_plain(f"coalesce({e}, '')")


def code_blobs(e: str) -> str:
    return rr(f"coalesce({e}, '')", "[A-Za-z0-9+/=_-]{40,}", "…")


def tenths(hate: str, total: str) -> str:
    q = f"(({hate}) * 1000 // ({total}))"
    r = f"(({hate}) * 1000 % ({total}))"
    return (f"(CASE WHEN ({total}) > 0 THEN {q} + CASE WHEN 2 * {r} > ({total}) "
            f"OR (2 * {r} = ({total}) AND {q} % 2 = 1) THEN 1 ELSE 0 END ELSE 0 END)")


def tenths_str(t: str) -> str:
    return f"(CAST(({t}) // 10 AS VARCHAR) || '.' || CAST(({t}) % 10 AS VARCHAR))"


def finish_stats(src: str, key: str = "platform") -> str:
    """total/hate from ``src`` -> + safe, hate_pct, safe_pct."""
    t = tenths("hate", "total")
    return (f"SELECT {key}, total, hate, total - hate AS safe, "
            f"CAST({t} AS DOUBLE) / CAST(10 AS DOUBLE) AS hate_pct, "
            f"CASE WHEN total > 0 THEN CAST(1000 - {t} AS DOUBLE) / CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            f"AS safe_pct FROM {src}")


SCORED = f"""
scored AS (
  SELECT d.doc_id, d.source AS platform, d.text, d.lang,
         {kw_hit('d.text')} AS keyword_hit, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
pred AS (
  SELECT *, CASE WHEN keyword_hit THEN 1 ELSE coalesce(toxic, 0) END AS predicted_label,
         CASE WHEN keyword_hit THEN CAST(0.99 AS DOUBLE) WHEN toxic IS NOT NULL THEN CAST(1.0 AS DOUBLE)
              ELSE CAST(0.5 AS DOUBLE) END AS confidence
  FROM scored)"""


def conf_cell(e: str) -> str:
    return f"(printf('%.1f', round_even(({e}) * 100, 1)) || '%')"


# --- detection and statistics ----------------------------------------------------

@oracle("hybrid_label")
def _():
    return f"WITH {SCORED} SELECT doc_id, platform, keyword_hit, predicted_label, confidence FROM pred"


@oracle("platform_stats")
def _():
    return (f"WITH {SCORED}, c AS (SELECT platform, count(*) AS total, "
            f"count(*) FILTER (WHERE predicted_label = 1) AS hate FROM pred GROUP BY platform) "
            + finish_stats("c"))


@oracle("detect_counts")
def _():
    return (f"WITH {SCORED} SELECT platform, count(*) AS total, "
            f"count(*) FILTER (WHERE predicted_label = 1) AS hate_speech, "
            f"count(*) - count(*) FILTER (WHERE predicted_label = 1) AS safe FROM pred GROUP BY platform")


ROLLUP = (f"WITH {SCORED}, c AS (SELECT CASE WHEN grouping(platform) = 1 THEN 'Total' ELSE platform END AS platform, "
          f"count(*) AS total, count(*) FILTER (WHERE predicted_label = 1) AS hate "
          f"FROM pred GROUP BY ROLLUP (platform)) ")


@oracle("overall_rollup")
def _():
    return ROLLUP + finish_stats("c")


def _summary(dimension: str) -> str:
    t = tenths("hate", "total")
    st = f"(CASE WHEN total > 0 THEN 1000 - {t} ELSE 0 END)"
    return (f"WITH {SCORED}, dim AS ({dimension}), "
            f"c AS (SELECT platform, count(*) AS total, count(*) FILTER (WHERE predicted_label = 1) AS hate "
            f"FROM pred GROUP BY platform), "
            f"j AS (SELECT dim.platform, coalesce(c.total, 0) AS total, coalesce(c.hate, 0) AS hate "
            f"FROM dim LEFT JOIN c ON dim.platform = c.platform) "
            f"SELECT platform, total, "
            f"CAST(hate AS VARCHAR) || ' = ' || {tenths_str(t)} || '%' AS hate_cell, "
            f"CAST(total - hate AS VARCHAR) || ' = ' || {tenths_str(st)} || '%' AS safe_cell, "
            f"{tenths_str(t)} || '%' AS hate_pct_cell, {tenths_str(st)} || '%' AS safe_pct_cell FROM j")


@oracle("summary_table")
def _():
    return _summary("SELECT DISTINCT source AS platform FROM documents")


@oracle("summary_fixed")
def _():
    return _summary("SELECT * FROM (VALUES ('src0'), ('src1'), ('src2'), ('Messenger')) v(platform)")


@oracle("chart_series")
def _():
    return (ROLLUP + ", s AS (" + finish_stats("c") + ") "
            "SELECT platform, 'hate' AS series, hate AS count FROM s "
            "UNION ALL SELECT platform, 'safe' AS series, safe AS count FROM s")


# --- ranked listings ----------------------------------------------------------------

def listing_text(e: str) -> str:
    return code_blobs(report_clean(report_clean(e)))


@oracle("flagged_topn")
def _():
    return (f"WITH {SCORED} SELECT row_number() OVER (ORDER BY confidence DESC, doc_id) AS rank, doc_id, platform, "
            f"{conf_cell('confidence')} AS confidence_cell, {listing_text('text')} AS listing_text "
            f"FROM pred WHERE predicted_label = 1 ORDER BY confidence DESC, doc_id LIMIT 25")


@oracle("flagged_topn_platform")
def _():
    return (f"WITH {SCORED}, r AS (SELECT platform, row_number() OVER (PARTITION BY platform ORDER BY confidence DESC, "
            f"doc_id) AS rank, doc_id, confidence FROM pred WHERE predicted_label = 1) "
            f"SELECT platform, rank, doc_id, confidence, {conf_cell('confidence')} AS confidence_cell "
            f"FROM r WHERE rank <= 25")


@oracle("longest_texts")
def _():
    return ("SELECT row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank, doc_id, source, "
            "length(text) AS text_length FROM documents ORDER BY text_length DESC, doc_id LIMIT 25")


@oracle("all_texts")
def _():
    # DuckDB reads a file's rows in their order, so a running number is the place in the file
    soft = lambda e: rr(e, r"([\\/_-])", "\\1\u200b")
    day = "DATE '1970-01-01' + CAST(floor((1700000000000 + doc_id * 60000) / 86400000.0) AS INTEGER)"
    return (f"WITH pos AS (SELECT doc_id AS pos_id, row_number() OVER () AS pos FROM documents), {SCORED} "
            f"SELECT platform, row_number() OVER (PARTITION BY platform ORDER BY pos) AS rank, "
            f"doc_id, CASE WHEN predicted_label = 1 THEN 'Hate' ELSE 'Safe' END AS verdict, "
            f"{report_clean(report_clean('text'))} AS listing_text, strftime({day}, '%d/%m/%Y') AS date, "
            f"{soft('(platform || ' + lit('_data/a-b.db') + ')')} AS source_database, {soft(lit('messages_1'))} AS source_table "
            f"FROM pred JOIN pos ON doc_id = pos_id")


# --- scalar text operators ------------------------------------------------------------

@oracle("model_clean")
def _():
    return f"SELECT doc_id, {model_clean('text')} AS clean_text FROM documents"


@oracle("keyword_flag")
def _():
    return (f"SELECT 'documents' AS source_table, doc_id AS row_id, CAST(NULL AS BIGINT) AS turn, "
            f"{kw_hit('text')} AS keyword_hit FROM documents UNION ALL "
            f"SELECT 'conversations' AS source_table, conv_id AS row_id, turn, {kw_hit('text')} AS keyword_hit "
            f"FROM conversations")


@oracle("content_hash")
def _():
    return "SELECT doc_id, sha256(text) AS sha256_hash FROM documents"


# --- more text operators ----------------------------------------------------------------

NONBLANK = "[^" + X.PY_SPACE + "]"


def combine(cols: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN regexp_matches({c}, {lit(NONBLANK)}) THEN {c} END"
                                          for c in cols) + ")"


@oracle("text_combine")
def _():
    return (f"SELECT * FROM (SELECT 'documents' AS source_table, doc_id AS row_id, CAST(NULL AS BIGINT) AS turn, "
            f"{combine(['text', 'lang', 'source'])} AS combined FROM documents UNION ALL "
            f"SELECT 'conversations', conv_id, turn, {combine(['role', 'text'])} FROM conversations) "
            f"WHERE combined <> ''")


@oracle("strip_emojis")
def _():
    return f"SELECT doc_id, {strip_emojis('text')} AS stripped FROM documents"


@oracle("control_chars")
def _():
    return f"SELECT page_id, {ctrl('html')} AS spaced FROM pages"


@oracle("sanitize_text")
def _():
    return (f"SELECT 'documents' AS source_table, doc_id AS row_id, {sanitize('text')} AS sanitized FROM documents "
            f"UNION ALL SELECT 'pages', page_id, {sanitize('html')} FROM pages")


NOISY = """noisy AS (SELECT conv_id, turn,
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(conv_id AS VARCHAR) || ' ' ELSE '* ' END || text ||
  CASE (conv_id + turn) % 9 WHEN 0 THEN '' WHEN 1 THEN ' fts.db messages_content x' WHEN 2 THEN ' reverb_db_1'
    WHEN 3 THEN ' local_message_pe' WHEN 4 THEN ' direct.db  messages' WHEN 5 THEN ' crypto_db9'
    WHEN 6 THEN ' omnistore_x' WHEN 7 THEN ' enigma.db' ELSE chr(10) || '((0 B))' END AS noisy
  FROM conversations)"""


@oracle("prefix_noise")
def _():
    return f"WITH {NOISY} SELECT conv_id, turn, {prefix_noise('noisy')} AS result FROM noisy"


@oracle("suffix_noise")
def _():
    return f"WITH {NOISY} SELECT conv_id, turn, {suffix_noise('noisy')} AS result FROM noisy"


@oracle("report_clean")
def _():
    return f"WITH {NOISY} SELECT conv_id, turn, {report_clean('noisy')} AS result FROM noisy"


@oracle("bytes_literal")
def _():
    # A hex-escaped literal decodes back to the text; a literal with
    # mismatched quotes fails to parse and keeps s[2:] stripped of quotes.
    return ("SELECT doc_id, 'hex' AS variant, text AS decoded FROM documents UNION ALL "
            "SELECT doc_id, 'fallback', trim(text || '''', '\"''') FROM documents")


@oracle("soft_wrap")
def _():
    return f"SELECT page_id, {rr('coalesce(url, ' + lit('') + ')', r'([\\/_-])', chr(92) + '1' + chr(0x200B))} AS wrapped FROM pages"


@oracle("code_blobs")
def _():
    return (f"SELECT 'documents' AS source_table, doc_id AS row_id, {code_blobs('text')} AS reduced FROM documents "
            f"UNION ALL SELECT 'pages', page_id, {code_blobs('html')} FROM pages")


def py_strip_sql(e: str) -> str:
    return py_strip(e)


def handle(e: str) -> str:
    u = py_strip_sql(e)
    u = rr(u, '^"+|"+\\z', "")
    u = rr(u, "^'+|'+\\z", "")
    u = f"regexp_replace({u}, '^@', '')"
    return (f"(CASE WHEN contains({u}, '/') THEN regexp_extract({rr(u, '/+' + chr(92) + 'z', '')}, "
            f"'[^/]*\\z', 0) ELSE {u} END)")


@oracle("handle_normalise")
def _():
    return f"SELECT page_id, {handle('url')} AS handle FROM pages"


@oracle("name_from_path")
def _():
    path = f"({rr('url', r'[?#][\s\S]*', '')} || '.db')"
    return f"SELECT page_id, regexp_extract({path}, {lit(X.NAME_FROM_PATH)}, 1) AS name FROM pages"


# --- dates ---------------------------------------------------------------------------------

def numeric(e: str) -> str:
    s = py_strip(e)
    return (f"(CASE WHEN regexp_matches({e}, {lit(D.NUMERIC_PATTERN)}) THEN TRY_CAST({s} AS DOUBLE) "
            f"WHEN regexp_matches({e}, {lit('(?i)' + D.SPECIAL_FLOATS)}) THEN TRY_CAST(lower({s}) AS DOUBLE) END)")


def epoch_date(x: str) -> str:
    return (f"(CASE WHEN ({x}) >= 1e12 AND ({x}) <= {T.MS_MAX!r} THEN DATE '1970-01-01' + "
            f"CAST(floor(({x}) / 86400000.0) AS INTEGER) "
            f"WHEN ({x}) >= 1e9 AND ({x}) <= {T.S_MAX!r} THEN DATE '1970-01-01' + "
            f"CAST(floor(({x}) / 86400.0) AS INTEGER) END)")


def ymd(y: str, m: str, d: str) -> str:
    y, m, d = (f"TRY_CAST({v} AS INTEGER)" for v in (y, m, d))
    return (f"(CASE WHEN {y} BETWEEN 1677 AND 2262 THEN "
            f"CAST(try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d') AS DATE) END)")


def month_no(e: str) -> str:
    return "(CASE lower(" + e + ") " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(T.MONTHS, 1)) + " END)"


def text_date(e: str) -> str:
    s = py_strip(e)
    g = lambda pat, i: f"regexp_extract({s}, {lit(pat)}, {i})"
    m = lambda pat: f"regexp_matches({s}, {lit(pat)})"
    a, b = f"TRY_CAST({g(T.NUM_ABY, 1)} AS INTEGER)", f"TRY_CAST({g(T.NUM_ABY, 2)} AS INTEGER)"
    return (f"(CASE WHEN {m(T.ISO_YMD)} THEN {ymd(g(T.ISO_YMD, 1), g(T.ISO_YMD, 2), g(T.ISO_YMD, 3))} "
            f"WHEN {m(T.NUM_ABY)} THEN {ymd(g(T.NUM_ABY, 3), f'CASE WHEN {a} <= 12 THEN {a} ELSE {b} END', f'CASE WHEN {a} <= 12 THEN {b} ELSE {a} END')} "
            f"WHEN {m(T.COMPACT)} THEN {ymd(g(T.COMPACT, 1), g(T.COMPACT, 2), g(T.COMPACT, 3))} "
            f"WHEN {m(T.YEAR_ONLY)} THEN {ymd(g(T.YEAR_ONLY, 1), '1', '1')} "
            f"WHEN {m(T.MON_D_Y)} THEN {ymd(g(T.MON_D_Y, 3), month_no(g(T.MON_D_Y, 1)), g(T.MON_D_Y, 2))} "
            f"WHEN {m(T.D_MON_Y)} THEN {ymd(g(T.D_MON_Y, 3), month_no(g(T.D_MON_Y, 2)), g(T.D_MON_Y, 1))} END)")


def value_date(e: str) -> str:
    return f"coalesce({epoch_date(numeric(e))}, {text_date(e)})"


def present(e: str, skip: list[str]) -> str:
    return f"({e} IS NOT NULL AND {py_strip(e)} NOT IN ({', '.join(lit(v) for v in skip)}))"


def first_date(cols: list[str], skip: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {present(c, skip)} THEN {value_date(c)} END" for c in cols) + ")"


EPOCHS = """ep AS (SELECT event_id, ts, epoch_us(ts) AS us, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS s_str,
  CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ms_str, CAST(epoch_us(ts) AS VARCHAR) AS us_str,
  CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS frac_str
  FROM events)"""


@oracle("epoch_parse")
def _():
    f = lambda c: f"strftime({epoch_date(numeric(c))}, '%Y-%m-%d')"
    return (f"WITH {EPOCHS} SELECT event_id, {f('s_str')} AS d_s, {f('ms_str')} AS d_ms, {f('us_str')} AS d_us, "
            f"{f('frac_str')} AS d_frac FROM ep")


@oracle("first_datetime")
def _():
    return (f"WITH {EPOCHS}, d AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ms_str WHEN 1 THEN s_str "
            f"WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%m/%d/%Y') "
            f"WHEN 4 THEN strftime(ts, '%d/%m/%Y') WHEN 5 THEN '0' WHEN 6 THEN 'None' "
            f"ELSE strftime(ts, '%b %-d, %Y') END AS sent, strftime(ts, '%Y%m%d') AS received FROM ep) "
            f"SELECT event_id, sent, coalesce(strftime({first_date(['sent', 'received'], T.SKIP_VALUES)}, '%Y-%m-%d'), '-') "
            f"AS date_time FROM d")


@oracle("msg_datetime")
def _():
    return ("WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN strftime(o_orderdate, "
            "'%d %b %Y') ELSE CAST(epoch_us(o_orderdate) // 1000 AS VARCHAR) END AS created_at, "
            "strftime(o_orderdate, '%Y/%m/%d') AS date FROM orders) "
            f"SELECT o_orderkey, coalesce(strftime({first_date(['created_at', 'date'], T.SKIP_VALUES_REPORT)}, "
            f"'%d/%m/%Y'), '-') AS msg_date FROM d")


@oracle("date_time_combo")
def _():
    return ("WITH d AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
            "ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date, strftime(o_orderdate, '%H:%M:%S') AS time "
            "FROM orders) "
            f"SELECT o_orderkey, coalesce(strftime({text_date(chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', date, time)')}, '%Y-%m-%d'), '-') "
            "AS combo_date FROM d")


# --- coercion and defaults -------------------------------------------------------------------

@oracle("coerce_numeric")
def _():
    return ("""WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN k || 'x' WHEN 1 THEN ' ' || k || ' '
      WHEN 2 THEN k || '.75' WHEN 3 THEN '-' || k || 'e1' WHEN 4 THEN k || 'd' ELSE k END AS raw
      FROM (SELECT event_id, regexp_extract(props, '"k": ([^}]*)', 1) AS k FROM events)),
    n AS (SELECT event_id, raw, """ + numeric("raw") + """ AS num FROM d)
    SELECT event_id, raw, num, TRY_CAST(trunc(num) AS INTEGER) AS int_val FROM n""")


@oracle("fill_defaults")
def _():
    return ("WITH j AS (SELECT d.doc_id, CASE WHEN l.quality = 0 THEN NULL ELSE d.text END AS text, "
            "CAST(l.toxic AS VARCHAR) AS predicted_label, "
            "CASE WHEN l.toxic IS NULL THEN NULL ELSE CAST(l.quality AS DOUBLE) END AS confidence, "
            "d.source AS source_database, d.lang AS source_table FROM documents d LEFT JOIN labels l "
            "ON d.doc_id = l.doc_id) "
            f"SELECT doc_id, length(coalesce(text, '')) AS text_len, "
            f"coalesce(TRY_CAST(trunc({numeric('predicted_label')}) AS INTEGER), 0) AS predicted_label, "
            f"coalesce(confidence, CAST(0 AS DOUBLE)) AS confidence, coalesce(source_database, '') AS source_database, "
            f"coalesce(source_table, '') AS source_table FROM j")


# --- columns, union, flattening ---------------------------------------------------------------

@oracle("role_projection")
def _():
    return ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
            "o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS date_time, 'orders.parquet' AS source_database, "
            "'orders' AS source_table FROM orders")


@oracle("union_by_name")
def _():
    return ("SELECT * FROM documents UNION ALL BY NAME SELECT * FROM conversations "
            "UNION ALL BY NAME SELECT * FROM benchmark")


MIXED_PARTS = [("documents", "doc_id", "text", "CAST(n_chars AS DOUBLE)", "CAST(NULL AS BIGINT)"),
               ("conversations", "conv_id", "CAST(turn AS VARCHAR)", "turn / 2.0::DOUBLE", "CAST(turn % 2 = 0 AS BIGINT)"),
               ("labels", "doc_id", "CASE WHEN toxic = 1 THEN 'True' WHEN toxic <> 1 THEN 'False' END", "CAST(toxic AS DOUBLE)",
                "CAST(quality AS BIGINT)")]


@oracle("union_mixed_types")
def _():
    return " UNION ALL ".join(f"SELECT {i} AS id, {body} AS body, {size} AS size, {flag} AS flag FROM {src}"
                              for src, i, body, size, flag in MIXED_PARTS)


@oracle("flatten_mixed_types")
def _():
    parts = [f"SELECT {combine([body])} AS text, '-' AS date_time, '{src}.parquet' AS source_database, "
             f"'{src}' AS source_table FROM {src}" for src, _, body, _, _ in MIXED_PARTS]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE text <> ''"


@oracle("extract_flatten")
def _():
    def part(tbl, src, pieces, dt):
        return (f"SELECT {combine(pieces) if pieces else chr(39) * 2} AS text, {dt} AS date_time, "
                f"'{src}.parquet' AS source_database, '{tbl}' AS source_table FROM {src}")
    ev = ("(SELECT event_id, props AS content, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS kind FROM events) AS events")
    ev_dt = f"coalesce(strftime({first_date(['CAST(timestamp_ms AS VARCHAR)'], T.SKIP_VALUES)}, '%Y-%m-%d'), '-')"
    parts = [part("documents", "documents", ["text"], "'-'"), part("conversations", "conversations", ["text"], "'-'"),
             part("benchmark", "benchmark", ["text"], "'-'"), part("pages", "pages", [], "'-'"),
             part("orders", "orders", [], "strftime(o_orderdate, '%Y-%m-%d')"),
             part("event_log", ev, ["content"], ev_dt).replace(f"'{ev}.parquet'", "'events.parquet'")]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE text <> ''"


@oracle("first_present_column")
def _():
    wrap = lambda e: rr(f"coalesce({e}, '')", r"([\\/_-])", chr(92) + "1" + chr(0x200B))
    return (f"SELECT doc_id, {wrap('source')} AS database_cell, {wrap('sha256(text)')} AS hash_cell FROM documents")


# --- labelled dataset ----------------------------------------------------------------------

MERGED = f"""j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s1 AS (SELECT doc_id, text AS Sentence, CASE WHEN toxic = 1 THEN 'Offensive' WHEN quality = 1 THEN 'Not offensive'
        ELSE 'Unsure' END AS Hate_speech FROM j WHERE lang = 'en'),
s2 AS (SELECT doc_id, text AS comment, CASE WHEN quality = 0 THEN 'n/a' ELSE CAST(toxic AS VARCHAR) END AS label
        FROM j WHERE lang IN ('fr', 'de')),
s3 AS (SELECT doc_id, text AS comment, CAST(toxic AS VARCHAR) || '.0' AS label FROM j WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')),
merged AS (
  SELECT doc_id, Sentence AS text, CASE Hate_speech WHEN 'Offensive' THEN 1 ELSE 0 END AS label FROM s1
    WHERE Hate_speech IN ('Offensive', 'Not offensive')
  UNION ALL SELECT doc_id, comment, TRY_CAST(trunc({numeric('label')}) AS INTEGER) FROM s2 WHERE {numeric('label')} IS NOT NULL
  UNION ALL SELECT doc_id, comment, TRY_CAST(trunc({numeric('label')}) AS INTEGER) FROM s3 WHERE {numeric('label')} IS NOT NULL),
clean AS (SELECT * FROM merged WHERE doc_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
folded AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('42:' || text), 1, 8) AS BIGINT) % 100 < 20
           THEN 'validation' ELSE 'train' END AS fold FROM clean)"""


@oracle("label_merge")
def _():
    return f"WITH {MERGED} SELECT doc_id, text, label FROM clean"


@oracle("class_balance")
def _():
    return (f"WITH {MERGED} SELECT label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, label) AS place "
            f"FROM clean GROUP BY label")


@oracle("split_exact")
def _():
    return (f"WITH {MERGED}, h AS (SELECT doc_id, label, substr(md5('42:' || text), 1, 15) AS h FROM clean), "
            f"r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rn, count(*) OVER () AS n FROM h) "
            f"SELECT doc_id, label, CASE WHEN rn <= (n * 20 + 99) // 100 THEN 'validation' ELSE 'train' END AS fold FROM r")


@oracle("split")
def _():
    return f"WITH {MERGED} SELECT doc_id, label, fold FROM folded"


@oracle("accuracy")
def _():
    return (f"WITH {MERGED} SELECT fold, count(*) AS n, avg(CASE WHEN CAST({kw_hit('text')} AS INTEGER) = label "
            f"THEN 1.0 ELSE 0.0 END) AS accuracy FROM folded GROUP BY fold")


# --- modes and handles ------------------------------------------------------------------------

def mode_sql(tbl: str, col: str) -> str:
    v = py_strip(col)
    return (f"(SELECT '{col}' AS column_name, value, n FROM (SELECT {v} AS value, count(*) AS n FROM {tbl} "
            f"WHERE {col} IS NOT NULL AND {v} <> '' GROUP BY 1) ORDER BY n DESC, value LIMIT 1)")


@oracle("mode_nonempty")
def _():
    return " UNION ALL ".join([mode_sql("conversations", "role"), mode_sql("documents", "lang"),
                               mode_sql("events", "event_type")])


HANDLES = f"""f AS (SELECT source AS platform, CASE WHEN lang = 'de' THEN '@' || lang ELSE '' END AS username,
    lang AS author FROM documents),
st AS (SELECT platform, 'username' AS column_name, 0 AS prio, {py_strip('username')} AS value FROM f
       UNION ALL SELECT platform, 'author', 1, {py_strip('author')} FROM f),
c AS (SELECT platform, column_name, prio, value, count(*) AS n FROM st WHERE value IS NOT NULL AND value <> ''
      GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY platform, column_name ORDER BY n DESC, value) AS rn FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY prio) AS r2 FROM m WHERE rn = 1),
h AS (SELECT platform, column_name, {handle('value')} AS handle FROM b WHERE r2 = 1)"""


@oracle("infer_handle")
def _():
    return f"WITH {HANDLES} SELECT platform, column_name, handle FROM h"


@oracle("platform_summary")
def _():
    return (f"WITH {SCORED}, {HANDLES}, cnt AS (SELECT platform, count(*) AS total, "
            f"count(*) FILTER (WHERE predicted_label = 1) AS hate FROM pred GROUP BY platform), "
            f"s AS ({finish_stats('cnt')}) SELECT s.*, h.handle FROM s LEFT JOIN h ON s.platform = h.platform")


# --- evidence files ----------------------------------------------------------------------

SHARDS = """sh AS (SELECT source, greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)) AS k FROM documents GROUP BY source),
dbs AS (SELECT d.doc_id, d.text, d.source || '_' || CAST(d.doc_id % sh.k AS VARCHAR) || '.db' AS source_database
        FROM documents d JOIN sh ON d.source = sh.source)"""


@oracle("sqlite_scan")
def _():
    return (f"WITH {SHARDS} SELECT source_database, 'messages' AS source_table, count(*) AS n_rows FROM dbs GROUP BY 1 "
            f"UNION ALL SELECT source_database, 'counters', count(*) FROM dbs GROUP BY 1")


def _parsed():
    na = ", ".join(lit(v) for v in D.NA_LITERALS)
    text = f"CASE WHEN text IN ({na}) THEN NULL ELSE text END"
    return (f"WITH {SHARDS}, p AS (SELECT {combine([text])} AS text, "
            f"strftime(DATE '1970-01-01' + CAST(floor((1700000000000 + doc_id * 60000) / 86400000.0) AS INTEGER), "
            f"'%Y-%m-%d') AS date_time, source_database, 'messages' AS source_table FROM dbs) "
            f"SELECT * FROM p WHERE text <> ''")


@oracle("parse_all")
def _():
    return _parsed()


@oracle("archive_parse")
def _():
    return _parsed()


@oracle("csv_roundtrip")
def _():
    na = ", ".join(lit(v) for v in D.NA_LITERALS)
    return (f"WITH {SCORED} SELECT {report_clean(f'CASE WHEN text IN ({na}) THEN NULL ELSE text END')} AS text, "
            f"predicted_label, confidence, '-' AS date_time, platform AS source_database, "
            f"'documents' AS source_table FROM pred")


@oracle("tar_members")
def _():
    return (f"WITH {SHARDS}, s AS (SELECT DISTINCT d.source, d.doc_id % sh.k AS shard FROM documents d "
            f"JOIN sh ON d.source = sh.source) "
            f"SELECT source || '_data_' || CAST(shard // 16 AS VARCHAR) || '.tar' AS archive, "
            f"'data/data/' || source || '/databases/' || source || '_' || CAST(shard AS VARCHAR) || '.db' AS member "
            f"FROM s")


@oracle("member_hash")
def _():
    return ("SELECT 'd/doc_' || CAST(doc_id AS VARCHAR) || '.db' AS member, CAST(strlen(text) AS BIGINT) AS length, "
            "sha256(text) AS sha256_hash, CAST(NULL AS VARCHAR) AS error FROM documents")


@oracle("flagged_listing")
def _():
    soft = lambda e: rr(e, r"([\\/_-])", "\\1\u200b")
    day = "DATE '1970-01-01' + CAST(floor((1700000000000 + doc_id * 60000) / 86400000.0) AS INTEGER)"
    return (f"WITH {SCORED}, r AS (SELECT platform, row_number() OVER (PARTITION BY platform ORDER BY confidence DESC, doc_id) "
            f"AS rank, doc_id, confidence, text FROM pred WHERE predicted_label = 1) "
            f"SELECT platform, rank, {conf_cell('confidence')} AS confidence, {code_blobs(report_clean('text'))} AS text, "
            f"strftime({day}, '%d/%m/%Y') AS date, "
            f"{soft('(platform || ' + lit('_data/a-b.db') + ')')} AS source_database, {soft(lit('messages_1'))} AS source_table "
            f"FROM r WHERE rank <= 25")


@oracle("date_shapes")
def _():
    # of 30 renderings the last two are no dates, the four before them name a month only
    return ("SELECT event_id, CASE WHEN event_id % 30 >= 28 THEN '-' WHEN event_id % 30 >= 24 THEN strftime(ts, '%Y-%m-01') "
            "ELSE strftime(ts, '%Y-%m-%d') END AS date_time FROM events")


def _flat(cols: list[str]) -> str:
    return (f"SELECT {combine(cols)} AS text, '-' AS date_time, 'documents.parquet' AS source_database, "
            f"'documents' AS source_table FROM documents WHERE {combine(cols)} <> ''")


@oracle("flatten_numeric")
def _():
    return _flat(["text"])


@oracle("string_fallback")
def _():
    return _flat(["lang", "source", "'-'", "'documents.parquet'", "'documents'"])


@oracle("infer_device")
def _():
    return ("SELECT 'device' AS column_name, lang AS value FROM documents WHERE trim(lang) <> '' "
            "GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1")


@oracle("platform_sink")
def _():
    return f"WITH {SCORED} SELECT doc_id, platform, predicted_label, confidence FROM pred WHERE platform IN ('src2', 'Messenger')"


@oracle("missing_source")
def _():
    return "SELECT 'documents' AS source, count(*) AS total FROM documents UNION ALL SELECT 'absent', 0"


@oracle("falsy_to_empty")
def _():
    return ("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN coalesce(role, '') ELSE '' END AS role_cell, "
            "CASE WHEN turn IS NULL OR turn = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS turn_cell, "
            "CASE WHEN turn > 1 THEN 'True' ELSE '' END AS later_cell FROM conversations")


@oracle("report_dates")
def _():
    return ("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_cell, "
            "CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS text_cell FROM orders")


@oracle("score_relational")
def _():
    def words(name, src):
        return (f"{name} AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, "
                f"unnest(string_split({model_clean('text')}, ' ')) AS term FROM {src}) WHERE term <> '' GROUP BY doc_id, term)")

    steps = []
    for k in range(1, 4):
        j = k - 1
        steps += [
            f"r{k} AS MATERIALIZED (SELECT tr.doc_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(coalesce(z, 0) + b))) - label AS r FROM tr "
            f"CROSS JOIN b{j} LEFT JOIN (SELECT doc_id, sum(x * w) AS z FROM x JOIN w{j} USING (term) GROUP BY doc_id) m "
            f"ON tr.doc_id = m.doc_id)",
            f"w{k} AS MATERIALIZED (SELECT w{j}.term, w - 8.0::DOUBLE * (coalesce(g / n, 0) + 0.0001::DOUBLE * w) AS w FROM w{j} "
            f"CROSS JOIN n LEFT JOIN (SELECT term, sum(x * r) AS g FROM x JOIN r{k} USING (doc_id) GROUP BY term) g ON w{j}.term = g.term)",
            f"b{k} AS MATERIALIZED (SELECT min(b) - 8.0::DOUBLE * avg(r) AS b FROM r{k} CROSS JOIN b{j})"]
    return (f"WITH {MERGED}, placed AS (SELECT doc_id, text, label, row_number() OVER (ORDER BY substr(md5('42:' || text), 1, 15), doc_id) "
            f"AS rn, count(*) OVER () AS total FROM clean), "
            f"tr AS MATERIALIZED (SELECT doc_id, text, label FROM placed WHERE rn > (total * 20 + 99) // 100), "
            f"n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM tr), {words('tk', 'tr')}, "
            f"idf AS MATERIALIZED (SELECT term, ln((min(n) + 1) / (count(*) + 1)) AS idf FROM tk CROSS JOIN n GROUP BY term), "
            f"raw AS (SELECT doc_id, term, tf * idf AS x FROM tk JOIN idf USING (term)), "
            f"x AS MATERIALIZED (SELECT doc_id, term, coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 0) AS x FROM raw), "
            f"w0 AS (SELECT term, 0.0::DOUBLE AS w FROM idf), b0 AS (SELECT 0.0::DOUBLE AS b), " + ", ".join(steps) + ", "
            + words("dk", "documents") + ", "
            "sums AS (SELECT doc_id, sum(tf * idf * w) AS s, sqrt(sum(tf * idf * tf * idf)) AS l FROM dk JOIN idf USING (term) "
            "JOIN w3 USING (term) GROUP BY doc_id), "
            "m AS (SELECT d.doc_id, coalesce(s / nullif(l, 0), 0) + b AS margin FROM documents d CROSS JOIN b3 LEFT JOIN sums USING (doc_id)), "
            "p AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) AS p FROM m) "
            "SELECT doc_id, round(margin, 6) AS margin, CAST(margin > 0 AS INTEGER) AS model_label, "
            "round(greatest(p, 1 - p), 6) AS model_confidence FROM p")


@oracle("handle_from_path")
def _():
    return ("SELECT source AS platform, CASE WHEN count(*) FILTER (WHERE lang = 'de' AND source < 'src2') > 0 THEN 'de' "
            "ELSE arg_min(source || '_' || lang, doc_id) FILTER (WHERE lang IS NOT NULL) END AS handle "
            "FROM documents GROUP BY source HAVING handle IS NOT NULL")
