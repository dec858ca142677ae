"""Scalar text functions (Column -> Column), all JVM-side regex expressions.

The evidence pipeline cleans text in two ways: ``model_clean`` prepares the
classifier input, ``report_clean`` prepares text for the report listings.
Each function keeps the semantics of Python's ``re`` module on ``str``:

* Python's ``\\s`` / ``str.strip()`` know 29 whitespace characters, Java's and
  RE2's ``\\s`` only six, so the class is spelled out (``PY_SPACE``).
* Python's ``.`` stops only at ``\\n``; Java's also at ``\\r``, U+0085 and
  U+2028/9, so every "rest of the line/text" is an explicit class.
* Python's ``$`` (no MULTILINE) also matches before a final ``\\n``; written
  here as ``\\n?\\z``.

The same patterns run unchanged in RE2 (DuckDB), which the SQL oracle uses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- character classes -----------------------------------------------------

# Characters for which Python's str.isspace() is true.
PY_SPACE = (r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same set as plain characters, for trim functions.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")

# Fixed values (must equal the reference): Sinhala letters and vowel signs the
# classifier cleaner keeps besides word characters, in the reference's order.
# Omitted on purpose there: virama U+0DCA, U+0DDE, U+0D83 and ZWJ.
MODEL_KEEP_SINHALA = "අ-ෆාැෑුූිීෙේෛොෝෘෲෟාං"

# Fixed values (must equal the reference): emoji ranges removed from reports.
EMOJI_CLASS = r"\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}"

# Control characters replaced by a space in reports.
CONTROL_CLASS = r"\x00-\x08\x0B\x0C\x0E-\x1F"

# Fixed values (must equal the reference): characters a report keeps, in the
# reference's order; everything else is dropped.
REPORT_KEEP_RANGES = [(0x09, 0x09), (0x0A, 0x0A), (0x0D, 0x0D), (0x20, 0x20), (0x41, 0x5A), (0x61, 0x7A),
                      (0x2000, 0x206F), (0x20, 0x7E), (0x0D80, 0x0DFF)]


def _class_body(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _complement(ranges, top: int = 0x10FFFF):
    out, nxt = [], 0
    for a, b in sorted(ranges):
        if a > nxt:
            out.append((nxt, a - 1))
        nxt = max(nxt, b + 1)
    if nxt <= top:
        out.append((nxt, top))
    return out


REPORT_KEEP_CLASS = _class_body(REPORT_KEEP_RANGES)
# The dropped characters as a positive class: Java evaluates a negated class
# with wide ranges about 6x slower than the same set written positively.
REPORT_DROP_CLASS = _class_body(_complement(REPORT_KEEP_RANGES))

# Fixed values (must equal the reference): junk fragments that end a message
# in the report, tried in this order, case-insensitively; Python patterns.
SUFFIX_JUNK = [
    r"reverb_db[^\s]*",
    r"local_?message_?pe",
    r"direct\.db\s+messages(?:_content)?",
    r"fts\.db\s+messages(?:_content)?",
    r"crypto_db[^\s]*",
    r"omnistore_[^\s]*",
    r"enigma\.db",
    r"\(\(\s*0\s*B.*$",
]

NONBLANK = "[^" + PY_SPACE + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- X1: classifier input ---------------------------------------------------

URL_PATTERN = "http[^" + PY_SPACE + "]+"
MODEL_DROP_PATTERN = r"[^\p{L}\p{N}_" + MODEL_KEEP_SINHALA + " ]+"


def model_clean(col) -> Column:
    """Drop URLs, squash non-word runs to one space, trim, lower-case.

    After the second replacement only word characters, kept Sinhala signs and
    U+0020 remain, so ``trim`` (spaces only) equals Python's ``strip()``.
    """
    s = F.regexp_replace(_c(col), URL_PATTERN, "")
    s = F.regexp_replace(s, MODEL_DROP_PATTERN, " ")
    return F.lower(F.trim(s))


# --- X3: combine text columns ------------------------------------------------

def combine_text(cols: list, sep: str = " | ") -> Column:
    """Join the non-blank pieces in column order; '' when none is left.

    ``concat_ws`` skips nulls, so a blank piece is turned into null first.
    """
    if not cols:
        return F.lit("")
    pieces = [F.when(_c(c).rlike(NONBLANK), _c(c)) for c in cols]
    return F.concat_ws(sep, *pieces)


def is_nonblank(col) -> Column:
    return F.coalesce(_c(col).rlike(NONBLANK), F.lit(False))


def py_strip(col) -> Column:
    """Python ``str.strip()`` with its full whitespace set (scans the ends only)."""
    return F.btrim(_c(col), F.lit(PY_SPACE_CHARS))


# --- X4, X5, X9: report sanitising -------------------------------------------

def strip_emojis(col) -> Column:
    """X4 (null -> '')."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), "[" + EMOJI_CLASS + "]+", "")


CONTROL_CHARS = "".join(chr(c) for c in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20)])


def control_to_space(col) -> Column:
    """X5 (a character map, no regex)."""
    return F.translate(_c(col), CONTROL_CHARS, " " * len(CONTROL_CHARS))


def _collapse_blanks(s: Column) -> Column:
    return F.regexp_replace(s, "[ \t]+", " ")


def sanitize_text(col) -> Column:
    """Emojis and control characters out, keep-set only, blanks collapsed, stripped.

    Emojis lie outside the keep-set, so the keep-set filter removes them too.
    """
    s = control_to_space(F.coalesce(_c(col), F.lit("")))
    s = F.regexp_replace(s, "[" + REPORT_DROP_CLASS + "]+", "")
    return py_strip(_collapse_blanks(s))


# --- X7, X8: noise around messages --------------------------------------------

# Leftmost start of a Sinhala character or two Latin letters; the lazy prefix
# makes the match begin there, the replacement keeps only the tail.  No match
# leaves the string unchanged, as in the reference.
PREFIX_NOISE = r"^[\s\S]*?((?:[\x{0D80}-\x{0DFF}]|[A-Za-z]{2})[\s\S]*)\z"


PREFIX_CLEAN = r"^(?:[\x{0D80}-\x{0DFF}]|[A-Za-z]{2})"


def strip_prefix_noise(col) -> Column:
    """Drop everything before the first Sinhala character or 2+ Latin letters.

    Texts that already start that way (most) skip the rewrite.
    """
    s = _c(col)
    return F.when(s.rlike(PREFIX_CLEAN), s).otherwise(F.regexp_replace(s, PREFIX_NOISE, "$1"))


# Any junk pattern needs one of these literals; one scan decides whether the
# eight ordered cuts have to run at all.
SUFFIX_TRIGGER = r"(?iu)reverb_db|local_?message_?pe|direct\.db|fts\.db|crypto_db|omnistore_|enigma\.db|\(\("


def _cut_pattern(python_pattern: str) -> str:
    """What a junk fragment removes: blanks before it, itself, and all that follows.

    The blanks start at the beginning of their run, so a run is looked at once
    however long it is.  ``\\s`` is Python's class, ``.`` stops at a newline only.
    """
    java = (python_pattern.replace(r"[^\s]", "[^" + PY_SPACE + "]").replace(r"\s", "[" + PY_SPACE + "]")
            .replace(".*$", r"[^\n]*\n?\z"))
    return "(?iu)(?<![" + PY_SPACE + "])[" + PY_SPACE + "]*+" + java + r"[\s\S]*"


def strip_suffix_noise(col) -> Column:
    """For each junk fragment in order, cut at its first match and strip the blanks before it."""
    s = _c(col)
    cut = s
    for pat in SUFFIX_JUNK:
        cut = F.regexp_replace(cut, _cut_pattern(pat), "")
    return F.when(s.rlike(SUFFIX_TRIGGER), cut).otherwise(s)


# --- X6: bytes literals --------------------------------------------------------

BYTES_LITERAL = r"^b(?:['\"]|['\"][\s\S]*['\"])\z"


def looks_like_bytes_literal(col) -> Column:
    """``s.startswith(("b'", 'b"')) and s.endswith(("'", '"'))``."""
    return _c(col).rlike(BYTES_LITERAL)


_bytes_udfs: dict = {}


def _get_bytes_udf(passthrough: bool = False):
    """Arrow UDF; its body is self-contained so workers need no package import.

    ``passthrough`` returns non-literals unchanged (used when the input is an
    expression: it is then evaluated once, as the UDF argument).
    """
    if passthrough not in _bytes_udfs:
        def decode_bytes_literal(s: pd.Series) -> pd.Series:
            import ast
            import codecs
            import re

            lit_re = re.compile(r"b(?:['\"]|['\"].*['\"])", re.S)

            def plain(v):
                """The bytes of a literal whose body holds no quote of its own kind, nor what a literal may not hold."""
                quote, body = v[1], v[2:-1]
                if (len(v) < 3 or v[-1] != quote or quote in body or not body.isascii() or "\n" in body or "\r" in body
                        or "\0" in body or (len(body) - len(body.rstrip("\\"))) % 2):
                    return None
                try:
                    return codecs.escape_decode(body.encode("ascii"))[0]  # what the literal itself is read with
                except ValueError:
                    return None

            def one(v):
                if v is None:
                    return None
                if passthrough and not lit_re.fullmatch(v):
                    return v
                found = plain(v)
                if found is not None:
                    return found.decode("utf-8", "ignore")
                if v[1] not in v[2:]:  # never closed, so nothing to be read
                    return v[2:].strip("\"'")
                try:
                    obj = ast.literal_eval(v)
                except Exception:
                    return v[2:].strip("\"'")
                if isinstance(obj, (bytes, bytearray)):
                    return obj.decode("utf-8", "ignore")
                return v

            return s.map(one)

        _bytes_udfs[passthrough] = F.pandas_udf(decode_bytes_literal, "string")
    return _bytes_udfs[passthrough]


def bytes_literal_to_text(col, gated: bool = True) -> Column:
    """``b'...'`` text (a SQLite BLOB printed by Python) back to UTF-8.

    Read in an Arrow UDF: the escapes of an ordinary literal by the codec that
    Python itself uses for them, anything else by ``ast.literal_eval`` (never
    ``eval``).  For a
    plain column (``gated``) only rows that look like a literal are sent (the
    others reach the worker as nulls); for a computed input (``gated=False``)
    the value is sent once and returned unchanged unless it is a literal, so
    the input expression is not evaluated again around the UDF.
    """
    s = _c(col)
    if gated:
        decoded = _get_bytes_udf()(F.when(looks_like_bytes_literal(s), s))
        return F.coalesce(decoded, s)
    return _get_bytes_udf(passthrough=True)(s)


# --- X10: the report's clean_text ----------------------------------------------

def report_clean(col, gated: bool = True) -> Column:
    """Bytes literal, emojis, controls, prefix noise, keep-set, suffix noise,
    underscores to spaces, blanks collapsed, stripped of `` \\n\\r\\t``."""
    c = _c(col)
    s = F.coalesce(bytes_literal_to_text(c, gated), F.lit(""))
    return report_clean_plain(s)


def report_clean_plain(col) -> Column:
    """X10 for text known not to hold bytes literals (no Python worker)."""
    s = control_to_space(strip_emojis(col))
    s = strip_prefix_noise(s)
    s = F.regexp_replace(s, "[" + REPORT_DROP_CLASS + "]+", "")
    s = strip_suffix_noise(s)
    s = F.translate(s, "_", " ")
    s = _collapse_blanks(s)
    return F.btrim(s, F.lit(" \n\r\t"))


# --- X11, X12: listing helpers ---------------------------------------------------

def soft_wrap(col) -> Column:
    """X11: a zero-width space after every backslash, slash, underscore and hyphen."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"([\\/_-])", "$1\u200b")


def reduce_code_blobs(col) -> Column:
    """Runs of 40+ base64/hash characters become an ellipsis."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), "[A-Za-z0-9+/=_-]{40,}", "…")


# --- X13, X14: handles and names ---------------------------------------------------

def normalise_handle(col) -> Column:
    """Strip, strip quotes, drop one leading '@', keep the last path segment."""
    u = py_strip(_c(col))
    u = F.regexp_replace(u, '^"+|"+\\z', "")
    u = F.regexp_replace(u, "^'+|'+\\z", "")
    u = F.regexp_replace(u, "^@", "")
    last = F.regexp_extract(F.regexp_replace(u, "/+\\z", ""), "[^/]*\\z", 0)
    return F.when(u.contains("/"), last).otherwise(u)


NAME_FROM_PATH = r"(?i)[\\/]+([A-Za-z0-9._-]{3,})\.(?:db|sqlite3?)\n?\z"


def name_from_path(col) -> Column:
    """Database name from a path ending in .db/.sqlite/.sqlite3 ('' if none)."""
    return F.regexp_extract(_c(col), NAME_FROM_PATH, 1)


# --- X15: rendered numbers --------------------------------------------------------

def tenths_str(tenths: Column) -> Column:
    t = tenths.cast("long")
    return F.concat(F.floor(t / F.lit(10)).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"))


def count_pct_string(count: Column, pct_tenths: Column) -> Column:
    """``f"{n} = {pct}%"`` for the summary tables."""
    return F.concat(count.cast("string"), F.lit(" = "), tenths_str(pct_tenths), F.lit("%"))


def confidence_percent(conf: Column) -> Column:
    """``f"{conf*100:.1f}%"``; '-' when the value is missing."""
    v = F.bround(conf.cast("double") * F.lit(100.0), 1)
    return F.when(conf.isNull(), F.lit("-")).otherwise(F.concat(F.format_string("%.1f", v), F.lit("%")))


def with_report_clean_twice(df, col: str, out: str):
    """X10 applied on load and again on rendering, as the report does.

    The first pass is projected as its own column so the second pass (whose
    bytes-literal gate reads its input twice) does not recompute it.
    """
    tmp = f"__{out}_pass1"
    return (df.withColumn(tmp, report_clean(F.col(col)))
              .withColumn(out, report_clean(F.col(tmp), gated=False)).drop(tmp))
