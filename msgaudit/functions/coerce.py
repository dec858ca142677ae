"""Type coercion, null handling and value mapping (JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PY_SPACE, py_strip

# Fixed values (must equal pandas' defaults, which the reference relies on when
# it reads CSV): strings that read_csv turns into a missing value.
NA_LITERALS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Decimal / scientific notation as pandas.to_numeric accepts it (surrounding
# whitespace allowed).  Spark's own cast also takes '1d' or '1.5f'; the regex
# keeps those out.
NUMERIC_PATTERN = (r"^[" + PY_SPACE + r"]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?["
                   + PY_SPACE + r"]*\z")
SPECIAL_FLOATS = r"^[" + PY_SPACE + r"]*[+-]?(?:inf|infinity|nan)[" + PY_SPACE + r"]*\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_numeric(col, dtype: T.DataType | None = None) -> Column:
    """``pd.to_numeric(errors='coerce')`` -> double (null when unparsable)."""
    c = _c(col)
    if dtype is not None and isinstance(dtype, T.NumericType):
        return c.cast("double")
    s = c.cast("string")
    v = py_strip(s).try_cast("double")
    # Spark's cast accepts everything pandas does (after the strip) and a
    # little more ('1d', '1.5f'); the regexes only run when the cast worked.
    ok = s.rlike(NUMERIC_PATTERN) | s.rlike("(?i)" + SPECIAL_FLOATS)
    return F.when(v.isNotNull() & ok, v)


def truncate_int(col) -> Column:
    """``astype(int)`` on a double: toward zero; out of range -> null."""
    return _c(col).try_cast("int")


def na_literals_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """pandas' CSV NA rule for string columns read by Spark."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    lits = [F.lit(v) for v in NA_LITERALS]
    return df.withColumns({c: F.when(F.col(c).isin(*lits), F.lit(None)).otherwise(F.col(c)) for c in cols})


def fill_defaults(df: DataFrame) -> DataFrame:
    """D5 (the report's ``load_df``): text-ish columns '' , label 0, confidence 0.0."""
    out = {}
    for c in ("text", "source_database", "source_table", "created_at", "date_time"):
        if c in df.columns:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    if "predicted_label" in df.columns:
        dtype = df.schema["predicted_label"].dataType
        out["predicted_label"] = F.coalesce(truncate_int(to_numeric("predicted_label", dtype)), F.lit(0))
    if "confidence" in df.columns:
        dtype = df.schema["confidence"].dataType
        out["confidence"] = F.coalesce(to_numeric("confidence", dtype), F.lit(0.0))
    return df.withColumns(out) if out else df


def map_values(col, mapping: dict, default=None) -> Column:
    """Dictionary lookup; keys outside the map give ``default`` (null)."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def falsy_to_empty(col, dtype: T.DataType | None = None) -> Column:
    """``str(x or "")``: null, no text, zero and false give no text; true gives ``True``."""
    c = _c(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c == 0, F.lit("")).otherwise(text) if isinstance(dtype, T.NumericType) else text
