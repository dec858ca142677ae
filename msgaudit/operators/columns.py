"""Finding text and time columns and flattening evidence tables.

Column roles are decided from *names* (metadata only, on the driver); all row
work is column expressions.  ``flatten_tables`` is the scalable form of the
reference's "union every table, then flatten": it computes the merged column
order from the names, projects every table to the four output columns first
and unions those narrow relations, so no wide sparse union is ever built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import NA_LITERALS
from ..functions.text import combine_text
from ..functions.timestamps import nice_date, with_nice_date

# Fixed values (must equal the reference): a column is a text column when its
# lower-cased name contains one of these words, a time column likewise.
TEXT_KEYWORDS = ["text", "message", "body", "caption", "comment", "title", "content", "description"]
TIME_KEYWORDS = [
    "time", "date", "timestamp", "created", "creation", "sent", "received", "delivered", "start_time",
    "client_time", "server_time", "message_time", "modified", "updated", "executed_time",
]

#: Text that reads back as a number or a boolean.
NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
BOOLEAN_TEXT = ["True", "False", "true", "false", "TRUE", "FALSE"]

FLAT_SCHEMA = "text string, date_time string, source_database string, source_table string"


def cols_matching(names: list[str], keywords: list[str]) -> list[str]:
    """Names containing any keyword (case-insensitive), original order."""
    return [c for c in names if any(k in c.lower() for k in keywords)]


def role_columns(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(text columns, time columns, selected); all columns when no text column."""
    text = cols_matching(names, TEXT_KEYWORDS)
    time = cols_matching(names, TIME_KEYWORDS)
    selected = list(dict.fromkeys(text + time)) if text else list(names)
    return text, time, selected


def string_columns(schema: T.StructType) -> list[str]:
    """The string-typed columns (fallback text columns)."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def first_present(columns: list[str], candidates: list[str], default_pos: int | None = None) -> str | None:
    """First candidate present in ``columns``, else the positional default."""
    for c in candidates:
        if c in columns:
            return c
    if default_pos is not None and columns:
        return columns[min(default_pos, len(columns) - 1)]
    return None


def role_projection(df: DataFrame) -> DataFrame:
    """C2 applied to a table."""
    _, _, selected = role_columns(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in selected])


@dataclass
class EvidenceTable:
    df: DataFrame
    source_database: str
    source_table: str


def extract_table(t: EvidenceTable) -> DataFrame:
    """One table as the extractor emits it: role columns + date_time + provenance."""
    df = t.df
    _, time, selected = role_columns(df.columns)
    proj = df.select(*[F.col(f"`{c}`") for c in selected])
    # The reference overwrites any source column named date_time.
    proj = with_nice_date(proj, "date_time", time) if time else proj.withColumn("date_time", F.lit("-"))
    return proj.withColumns({"source_database": F.lit(t.source_database), "source_table": F.lit(t.source_table)})


# The type of a merged column: the least that holds all of its tables' values.
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)


def _height(t: T.DataType) -> int:
    """Place in the chain null < boolean < int < double < string; 5 for anything else."""
    kinds = ((T.NullType,), (T.BooleanType,), _INTEGERS, _FRACTIONS, (T.StringType, T.CharType, T.VarcharType))
    return next((k for k, types in enumerate(kinds) if isinstance(t, types)), 5)


def join_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The lattice's join: equal types stay, numbers widen, whatever has nothing in common becomes text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    top = max(_height(a), _height(b))
    return {1: T.BooleanType(), 2: T.LongType(), 3: T.DoubleType()}.get(top, T.StringType())


def merged_types(dfs: list[DataFrame]) -> dict[str, T.DataType]:
    """Name -> type of every column of the union, in order of first appearance."""
    out: dict[str, T.DataType] = {}
    for d in dfs:
        for f in d.schema.fields:
            out[f.name] = join_types(out[f.name], f.dataType) if f.name in out else f.dataType
    return out


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value in the merged type; as text, truth values read True / False and nested values are JSON."""
    if have == want:
        return col
    if isinstance(want, T.StringType):
        if isinstance(have, T.BooleanType):
            return F.when(col, F.lit("True")).when(~col, F.lit("False"))
        if isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(col)
    return col.cast(want)


def union_by_name(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name, missing columns as null, duplicates kept, differing types merged first."""
    want = merged_types(dfs)
    out = None
    for d in dfs:
        d = d.select(*[as_type(F.col(f"`{f.name}`"), f.dataType, want[f.name]).alias(f.name) for f in d.schema.fields])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def merged_text_columns(extracted: list[DataFrame]) -> list[str]:
    """Columns of the merged relation that may hold text, in first-appearance order.

    A column of numbers or truth values in every table holds none; one that is
    text in some table is text in all.
    """
    merged = merged_types(extracted)
    strings = [c for c, t in merged.items() if isinstance(t, T.StringType)]
    if cols_matching(list(merged), TEXT_KEYWORDS):
        return cols_matching(strings, TEXT_KEYWORDS)
    return strings


def text_columns(extracted: list[DataFrame], names: list[str]) -> list[str]:
    """Those of ``names`` that hold text over all tables.

    A column whose values all read back as numbers, or all as truth values, is
    not text; NA literals are no values.  One job: every table's values become
    (column, is number, is truth value) rows, pre-aggregated in its tasks, and
    one row per column name comes back.
    """
    na = [F.lit(v) for v in NA_LITERALS]
    seen = None
    for d in extracted:
        types = {f.name: f.dataType for f in d.schema.fields}
        facts = []
        for i, c in enumerate(names):
            if c not in types or isinstance(types[c], T.NullType):
                continue
            v, t = F.col(f"`{c}`"), types[c]
            if isinstance(t, T.StringType):
                number, truth, held = v.rlike(NUMBER_TEXT), v.isin(*BOOLEAN_TEXT), v.isNotNull() & ~v.isin(*na)
            else:
                number, truth, held = F.lit(_height(t) in (2, 3)), F.lit(_height(t) == 1), v.isNotNull()
            facts.append(F.struct(F.lit(i).alias("i"), F.when(held, number).alias("n"), F.when(held, truth).alias("b")))
        if facts:
            rows = d.select(F.explode(F.array(*facts)).alias("f")).select("f.*")
            seen = rows if seen is None else seen.unionByName(rows)
    if seen is None:
        return []
    facts = {r["i"]: r["n"] or r["b"] for r in seen.groupBy("i").agg(F.min("n").alias("n"), F.min("b").alias("b")).collect()}
    return [c for i, c in enumerate(names) if not facts.get(i)]


def flatten(merged: DataFrame) -> DataFrame:
    """M1 on an already merged relation."""
    return flatten_tables([merged])


def flatten_tables(extracted: list[DataFrame], keep: list[str] | None = None) -> DataFrame:
    """M1 over U1 without building the wide union.

    Each extracted table contributes its text columns in the *merged* order.  A
    column is text if the merged type is and not all values, over all tables,
    are numbers or truth values; its values from tables that hold numbers there
    are then text as well.  Rows with no non-blank piece are dropped (F2).
    ``keep`` passes extra provenance columns through when every table has them.
    Every table is planned twice: once for the facts about its columns, once here.
    """
    order = text_columns(extracted, merged_text_columns(extracted))
    keep = list(keep or [])
    parts = []
    for d in extracted:
        types = {f.name: f.dataType for f in d.schema.fields}
        mine = [as_type(F.col(f"`{c}`"), types[c], T.StringType()) for c in order if c in types]
        if not mine:
            continue  # every row of this table would be dropped by F2: not read at all
        combined = combine_text(mine)
        if "date_time" in types:
            dt = F.coalesce(F.col("date_time").cast("string"), F.lit("-"))
        else:
            dt = nice_date([c for c in d.columns if c in cols_matching(d.columns, TIME_KEYWORDS)], d.schema)
        src_db = F.col("source_database").cast("string") if "source_database" in types else F.lit("")
        src_tb = F.col("source_table").cast("string") if "source_table" in types else F.lit("")
        parts.append(d.select(combined.alias("text"), dt.alias("date_time"), src_db.alias("source_database"),
                              src_tb.alias("source_table"), *[F.col(k) for k in keep]))
    if not parts:
        spark = extracted[0].sparkSession
        return spark.createDataFrame([], FLAT_SCHEMA + "".join(f", {k} string" for k in keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("text") != "")
