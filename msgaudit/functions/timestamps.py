"""Finding a message date in arbitrary evidence columns.

Everything is a JVM expression.  A value is tried as an epoch number first
(T1), then as free text (T4); the first column, in the given order, that is
neither blank nor a placeholder and parses wins (T2/T5).  Only the calendar
date is ever reported, so parsing is done at day precision with integer
arithmetic.

Free text is read by token roles.  A clock with its zone, a weekday, ordinal
endings and the words "of" and "at" are cut off; what remains is described by its
shape (``n`` for a number of one or two digits, 9999 for one of four, ``M`` for a
month's name, separators as blanks), and ``ROLES`` says for each shape which of
its numbers is the year, the month and the day.  So a new format is a new line of
the table.  The results are those of pandas/dateutil for these shapes: month
first unless that is impossible, the local date of a value with an offset, a year
of two digits in the hundred years around the present one.

A shape that the table lacks gives no date, nor does a bare time of day (which
pandas dates to today).  Years outside pandas' range 1677..2262 give no date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import to_numeric
from .text import py_strip

EPOCH_DAY = "1970-01-01"
MS_PER_DAY = 86_400_000.0
S_PER_DAY = 86_400.0
# pandas' Timestamp range ends at 2262-04-11 23:47:16.854775807.
MS_MAX = 9_223_372_036_854.775
S_MAX = 9_223_372_036.854775

# Fixed values (must equal the reference): placeholders that mean "no value".
SKIP_VALUES = ["", "0", "None", "nan", "NaN"]
SKIP_VALUES_REPORT = ["", "-", "0", "None", "nan", "NaN"]

# Fixed values (must equal the reference): column names the report tries, in
# this order, when it looks for a message date.
REPORT_DATE_CANDIDATES = [
    "created_at", "date_time", "datetime",
    "timestamp_ms", "message_timestamp", "msg_timestamp",
    "timestamp", "sent_at", "time_sent", "delivered_at",
    "received_at", "server_time", "client_time",
    "date_sent", "time", "date",
]

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _days_to_date(days: Column) -> Column:
    return F.date_add(F.lit(EPOCH_DAY).cast("date"), days.cast("int"))


def epoch_to_date(x: Column) -> Column:
    """>= 1e12 is milliseconds, [1e9, 1e12) seconds, anything else none."""
    return (F.when((x >= F.lit(1e12)) & (x <= F.lit(MS_MAX)), _days_to_date(F.floor(x / F.lit(MS_PER_DAY))))
             .when((x >= F.lit(1e9)) & (x <= F.lit(S_MAX)), _days_to_date(F.floor(x / F.lit(S_PER_DAY)))))


# --- tokens: each pattern cuts or names one kind -------------------------------------

_TIME = r"(?:[01]?[0-9]|2[0-3])(?::[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?(?: ?(?i:[ap]m))?| ?(?i:[ap]m))"
_PACKED_TIME = r"(?:[01][0-9]|2[0-3])(?:[0-5][0-9](?:[0-5][0-9](?:\.[0-9]{1,9})?)?)?"
_ZONE = (r"(?: ?(?!(?i:" + "|".join(MONTHS) + r"))(?:Z|[A-Z]{3,5})(?:[+-][0-9]{1,2})?| ?[+-][0-9]{1,2}(?::?[0-9]{2})?)?")
#: A clock: a time of day, digits behind the T of a date, or behind a whole date and a blank; then its zone.
CLOCK = (r"(?:(?<![0-9:.])" + _TIME + r"|(?<=[0-9]T)" + _PACKED_TIME + r"|(?<=^[0-9]{8} )" + _PACKED_TIME
         + r"|(?<=^[0-9]{4}-[0-9]{2}-[0-9]{2} )(?:[01][0-9]|2[0-3]))" + _ZONE + r"(?![0-9A-Za-z:])")
#: What says nothing about the date: weekday, the clock's mark, ordinal endings, "of".
_NOISE = (r"^(?i:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?),? "
          r"|^@,? |(?:T|,? (?:at )?)@\z| @(?= [0-9]{4}\z)|(?<=[0-9])(?i:st|nd|rd|th)(?![A-Za-z])| of(?= )")
_MONTH = (r"(?i)(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
          r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])")
_SEPARATORS = r"[-/ ]+|[,.] +"

#: Shape -> roles of its numbers: y year, m month, d day; a and b month and day in the order that fits; z a year of
#: two digits; abz the three in the order that fits; p the digits of a whole date, q three pairs of digits.
ROLES = {
    "9999": "y", "99999999": "p", "999999999999": "p", "99999999999999": "p", "999999": "q",
    "9999 n n": "ymd", "9999.n.n": "ymd", "n n 9999": "aby", "n.n.9999": "aby", "n n n": "abz", "n.n.n": "abz",
    "9999 n": "ym", "9999.n": "ym", "n 9999": "my",
    "M n 9999": "dy", "M.n.9999": "dy", "n M 9999": "dy", "n.M.9999": "dy", "9999 M n": "yd", "9999.M.n": "yd",
    "M 9999": "y", "M.9999": "y", "9999 M": "y", "9999.M": "y", "M n n": "dz", "n M n": "dz",
}


def date_bare(stripped: Column) -> Column:
    """The value with an at sign for its clock."""
    return F.when(stripped.rlike("[: T]"), F.regexp_replace(stripped, CLOCK, "@")).otherwise(stripped)


def date_core(bare: Column) -> Column:
    """The value without clock, weekday, ordinal endings and filler words."""
    return F.when(bare.rlike("[@A-Za-z]"), F.regexp_replace(bare, _NOISE, "")).otherwise(bare)


def date_tokens(core: Column) -> Column:
    """struct(roles, n: its numbers, month: number of the month's name); null roles for no known shape."""
    lettered = core.rlike("[A-Za-z]")
    shape = F.regexp_replace(F.when(lettered, F.regexp_replace(core, _MONTH, "M")).otherwise(core), _SEPARATORS, " ")
    shape = F.regexp_replace(F.translate(shape, "012345678", "9" * 9), "(?<!9)99?(?!9)", "n")
    table = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    name = F.lower(F.substring(F.regexp_extract(core, _MONTH, 1), 1, 3))
    month = F.when(lettered, F.nullif(((F.instr(F.lit("".join(MONTHS)), F.nullif(name, F.lit(""))) + 2) / 3).cast("int"), F.lit(0)))
    return F.struct(F.try_element_at(table, shape).alias("roles"), F.regexp_extract_all(core, F.lit("[0-9]+"), F.lit(0)).alias("n"),
                    month.alias("month"))


def _full_year(z: Column) -> Column:
    """The year of two digits that lies less than 50 years ahead of this one, or at most 50 behind."""
    low = F.year(F.current_date()) - 50
    return low + F.pmod(z - low, F.lit(100))


def date_numbers(t: Column) -> Column:
    """struct(three, packed, y, m, d, a, b, z): the numbers by role, those of packed digits cut apart; null for no shape."""
    roles, n = t["roles"], t["n"]
    whole = F.try_element_at(n, F.lit(1))
    pairs, packed = roles == "q", roles == "p"
    cut = lambda start, size: F.substring(whole, start, size).try_cast("int")

    def number(role: str, start: int, when: Column) -> Column:
        at = F.instr(roles, role)
        return F.when(when, cut(start, 4 if role == "y" else 2)).when(at > 0, F.try_element_at(n, at).try_cast("int"))

    clock = F.when(packed & (F.length(whole) > 8), F.rpad(F.substring(whole, 9, 6), 6, "0"))
    clock_ok = F.coalesce(clock.rlike("^(?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]"), F.lit(True))
    numbers = F.struct((pairs | (roles == "abz")).alias("three"), number("y", 1, packed).alias("y"),
                       number("m", 5, packed).alias("m"), number("d", 7, packed).alias("d"), number("a", 1, pairs).alias("a"),
                       number("b", 3, pairs).alias("b"), number("z", 5, pairs).alias("z"), t["month"].alias("month"))
    return F.when(roles.isNotNull() & clock_ok, numbers)


def numbers_date(x: Column) -> Column:
    """The date that the numbers make, or null."""
    year_first, day_first, ordered = x["three"] & (x["a"] > 31), x["a"] > 12, x["a"].isNotNull()
    short = F.when(year_first, x["a"]).otherwise(x["z"])
    year = F.coalesce(_full_year(short), x["y"])
    month = F.when(ordered, F.when(day_first, x["b"]).otherwise(x["a"])).otherwise(F.coalesce(x["m"], x["month"], F.lit(1)))
    day = (F.when(year_first, x["z"]).when(ordered, F.when(day_first, x["a"]).otherwise(x["b"]))
            .otherwise(F.coalesce(x["d"], F.lit(1))))
    date = F.to_date(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)))
    return F.when((date >= F.lit("1677-01-01").cast("date")) & (date <= F.lit("2262-12-31").cast("date")), date)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside conditional branches."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped_to_date(s: Column) -> Column:
    """The date of a stripped value; each step runs once."""
    return _let(date_bare(s), lambda bare: _let(date_core(bare), lambda core: _let(
        date_tokens(core), lambda t: _let(date_numbers(t), numbers_date))))


def text_to_date(col) -> Column:
    """T4: free-text date (see module docstring) -> DateType or null."""
    return _let(py_strip(_c(col)), stripped_to_date)


def value_to_date(col, dtype: T.DataType | None = None) -> Column:
    """Epoch first, then free text; timestamp/date columns give their date."""
    c = _c(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.DateType):
        return c
    return F.coalesce(epoch_to_date(to_numeric(c, dtype)), text_to_date(c.cast("string")))


def _present(col, dtype, skip) -> Column:
    c = _c(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.isNotNull()
    s = py_strip(c.cast("string"))
    return c.isNotNull() & ~s.isin(*[F.lit(v) for v in skip])


def first_date(cols: list[str], schema: T.StructType | None = None, skip=None,
               combo: tuple[str, str] | None = None) -> Column:
    """Date of the first usable column in order, else the date+time combo."""
    skip = SKIP_VALUES if skip is None else skip
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    tries = [F.when(_present(c, types.get(c), skip), value_to_date(c, types.get(c))) for c in cols]
    if combo is not None:
        d, t = combo
        tries.append(text_to_date(F.concat_ws(" ", F.col(d).cast("string"), F.col(t).cast("string"))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("date")


def nice_date(cols: list[str], schema: T.StructType | None = None) -> Column:
    """T2 rendered ``YYYY-MM-DD`` or ``-`` (the extractor's ``date_time``)."""
    names = list(cols)
    combo = ("date", "time") if ("date" in names and "time" in names) else None
    return F.coalesce(F.date_format(first_date(names, schema, combo=combo), "yyyy-MM-dd"), F.lit("-"))


def message_date(columns: list[str], schema: T.StructType | None = None) -> Column:
    """T5: the report's date: fixed candidate list, ``DD/MM/YYYY`` or ``-``."""
    present = [c for c in REPORT_DATE_CANDIDATES if c in columns]
    combo = ("date", "time") if ("date" in columns and "time" in columns) else None
    d = first_date(present, schema, skip=SKIP_VALUES_REPORT, combo=combo)
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit("-"))


def format_report_date(col) -> Column:
    """T6 ``format_ts``: ``DD/MM/YYYY`` or ``-``."""
    return F.coalesce(F.date_format(_c(col), "dd/MM/yyyy"), F.lit("-"))


# --- DataFrame-level forms (each regex runs once per value) -----------------------------
#
# A value is stripped, read as a number and as an epoch in projections of their
# own, so each runs once; the text is only read where that gave no date.

#: Column that the prepared date expression reads.
DATE_INPUT = "__date_in"
_prepared: dict[str, Column] = {}


def _date_of_input(spark) -> Column:
    """``stripped_to_date`` over DATE_INPUT, built once per application: it has hundreds of parts."""
    key = spark.sparkContext.applicationId
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = stripped_to_date(F.col(DATE_INPUT))
    return _prepared[key]


def _staged_dates(df, sources: dict, numeric: dict, present: dict | None = None):
    """Add ``__dt{k}`` (parsed date) for each ``k -> stripped-value expression``.

    Strip, number and epoch date are projected columns, so each runs once per value.
    ``numeric`` maps ``k`` to a number expression to try as an epoch first.
    Sources are taken in order and a later one is only parsed for rows where
    every earlier one gave no date (``present`` gives each source's usability
    test), as in the reference's first-usable-column rule.
    """
    tmp = []
    present = present or {}

    def add(cols: dict):
        nonlocal df
        df = df.withColumns(cols)
        tmp.extend(cols)

    add({f"__s{k}": e for k, e in sources.items()})
    found = None  # rows that already have a date from an earlier source
    for k in sources:
        need = F.lit(True) if found is None else F.col(found).isNull()
        usable = need & present[k] if k in present else need
        st = F.col(f"__s{k}")
        num = numeric.get(k)
        stage = {}
        if num is not None:
            stage[f"__n{k}"] = F.when(usable, num)
            add(stage)
            add({f"__e{k}": epoch_to_date(F.col(f"__n{k}"))})
            gate = usable & F.col(f"__e{k}").isNull()
        else:
            gate = usable
        add({DATE_INPUT: F.when(gate, st)})
        text_date = F.when(F.col(DATE_INPUT).isNotNull(), _date_of_input(df.sparkSession))
        date = F.coalesce(F.col(f"__e{k}"), text_date) if num is not None else text_date
        add({f"__dt{k}": F.when(usable, date)})
        acc = f"__acc{k}"
        add({acc: F.col(f"__dt{k}") if found is None else F.coalesce(F.col(found), F.col(f"__dt{k}"))})
        found = acc
    return df, tmp


def with_first_date(df, out: str, cols: list[str], skip=None, combo: tuple[str, str] | None = None,
                    fmt: str | None = None, missing: str | None = None):
    """T2/T3/T5 as a DataFrame transform: ``out`` = date of the first usable column.

    ``fmt`` renders the date (``yyyy-MM-dd`` for the extractor, ``dd/MM/yyyy``
    for the report) and ``missing`` replaces "no date" (``-``).
    """
    skip = SKIP_VALUES if skip is None else skip
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = {}
    for i, c in enumerate(cols):
        dt = types.get(c)
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            plain[i] = F.to_date(F.col(f"`{c}`"))
        elif isinstance(dt, T.DateType):
            plain[i] = F.col(f"`{c}`")
    res = None
    tmp = []
    if plain and len(plain) == len(cols) and combo is None:
        res = F.coalesce(*[plain[i] for i in range(len(cols))])
    else:
        sources, numeric, present = {}, {}, {}
        for i, c in enumerate(cols):
            col = F.col(f"`{c}`")
            if i in plain:
                # a date/timestamp column is a source that needs no parsing
                sources[i] = F.lit(None).cast("string")
                continue
            dt = types.get(c)
            sources[i] = py_strip(col.cast("string"))
            numeric[i] = to_numeric(col, dt) if isinstance(dt, T.NumericType) else to_numeric(F.col(f"__s{i}"))
            present[i] = col.isNotNull() & ~F.col(f"__s{i}").isin(*[F.lit(v) for v in skip])
        if combo is not None:
            d, t = combo
            sources["x"] = py_strip(F.concat_ws(" ", F.col(f"`{d}`").cast("string"), F.col(f"`{t}`").cast("string")))
        if plain:
            # keep the column order: a plain date column answers before later sources
            df = df.withColumns({f"__pl{i}": e for i, e in plain.items()})
            tmp.extend(f"__pl{i}" for i in plain)
            for i in plain:
                present[i] = F.lit(False)
        df, staged = _staged_dates(df, sources, numeric, present)
        tmp.extend(staged)
        tries = []
        for i in range(len(cols)):
            tries.append(F.col(f"__pl{i}") if i in plain else F.col(f"__dt{i}"))
        if combo is not None:
            tries.append(F.col("__dtx"))
        res = F.coalesce(*tries) if tries else F.lit(None).cast("date")
    if fmt is not None:
        res = F.date_format(res, fmt)
    if missing is not None:
        res = F.coalesce(res, F.lit(missing))
    return df.withColumn(out, res).drop(*tmp)


def with_nice_date(df, out: str, cols: list[str]):
    """The extractor's ``date_time`` (``YYYY-MM-DD`` or ``-``)."""
    combo = ("date", "time") if ("date" in cols and "time" in cols) else None
    return with_first_date(df, out, cols, combo=combo, fmt="yyyy-MM-dd", missing="-")


def with_message_date(df, out: str):
    """T5: the report's date over the fixed candidate columns (``DD/MM/YYYY`` or ``-``)."""
    present = [c for c in REPORT_DATE_CANDIDATES if c in df.columns]
    combo = ("date", "time") if ("date" in df.columns and "time" in df.columns) else None
    return with_first_date(df, out, present, skip=SKIP_VALUES_REPORT, combo=combo, fmt="dd/MM/yyyy", missing="-")


def nice_datetime(col) -> Column:
    """T6 ``nice_datetime``: ``DD/MM/YYYY`` when the text parses, else the text itself."""
    c = _c(col)
    return F.coalesce(F.date_format(text_to_date(c), "dd/MM/yyyy"), F.coalesce(c.cast("string"), F.lit("")))
