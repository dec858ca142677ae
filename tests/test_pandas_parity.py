"""Parity with pandas, whose behaviour the reference inherits (numbers, epochs, dates)."""
import datetime as dt
import math
import warnings

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgaudit.functions import timestamps as T
from msgaudit.functions.coerce import to_numeric

NUMERIC_TOKENS = st.sampled_from(["12", " 12 ", "1e3", "-4.5", "+5", ".5", "5.", "1_000", "0x10", "1,000", "abc",
                                  "1d", "1.5f", "inf", "-inf", "nan", "", "3e", "007", "1e-2", "\t8\n"])


@settings(max_examples=25, deadline=None)
@given(st.lists(NUMERIC_TOKENS, min_size=1, max_size=10))
def test_to_numeric_matches_pandas(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.o for r in df.select("i", to_numeric(F.col("s")).alias("o")).orderBy("i").collect()]
    for v, g in zip(values, got):
        want = pd.to_numeric(v, errors="coerce")
        if pd.isna(want):
            assert g is None or (isinstance(g, float) and math.isnan(g)), (v, g)
        else:
            assert g == float(want), (v, g, want)


def _shapes(d: dt.date):
    m = d.strftime("%b")
    out = [d.isoformat(), d.strftime("%Y/%m/%d"), d.strftime("%Y-%m-%d 10:30:15"), d.strftime("%Y-%m-%dT23:00-05:00"),
           d.strftime("%Y%m%d"), f"{m} {d.day}, {d.year}", f"{d.day} {m} {d.year}", d.strftime("%B %d %Y")]
    out += [d.strftime("%d-%b-%Y"), d.strftime("%d %B %Y 14:05"), d.strftime("%a, %d %b %Y 10:30:00 +0000"), d.strftime("%a %b %d 10:30:15 %Y"),
            d.strftime("%Y.%m.%d"), d.strftime("%Y%m%dT103015"), d.strftime("%Y-%m-%d 02:05 PM"), d.strftime("%Y-%m-%d 10:30:00 UTC"),
            d.strftime("%Y-%m-%d 10:30:00 +05:30"), d.strftime("%b %d, %Y 11:59:59 PM"), d.strftime("%A, %B %d, %Y"), d.strftime("%A %d %B %Y")]
    if d.day > 12:
        out += [d.strftime("%m/%d/%Y"), d.strftime("%d/%m/%Y"), d.strftime("%d-%m-%Y"), d.strftime("%d.%m.%Y")]
    else:
        out += [d.strftime("%m/%d/%Y")]
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dates(min_value=dt.date(1971, 1, 1), max_value=dt.date(2200, 12, 31)), min_size=1, max_size=6))
def test_text_dates_match_pandas(spark, dates):
    values = [s for d in dates for s in _shapes(d)] + [str(d.year) for d in dates]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.o for r in T.with_first_date(df, "o", ["s"], fmt="yyyy-MM-dd").orderBy("i").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [pd.to_datetime(v, errors="coerce") for v in values]
    for v, g, w in zip(values, got, want):
        assert g == w.strftime("%Y-%m-%d"), (v, g, w)


def test_months_and_refusals_match_pandas(spark):
    values = ["2025-08", "2025/08", "2025-08-21 99:99", "Janxxxx 1, 2020", "2025-08-21 10:61", "32 Aug 2025", "Foo, 21 Aug 2025",
              "2025-13", "21-August-2025", "June 5 2020", "Sept 5, 2020", "5 Sept 2020"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.o for r in T.with_first_date(df, "o", ["s"], fmt="yyyy-MM-dd").orderBy("i").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [pd.to_datetime(v, errors="coerce") for v in values]
    assert got == [None if pd.isna(w) else w.strftime("%Y-%m-%d") for w in want]


# Further shapes, some of them no dates; the year of two digits follows the present one in pandas as here.
MORE_SHAPES = """20250821 103000|20250821103000|202508211030|08-21-25|21/08/25|08/21/25|25/08/21|Aug 2025|August 2025|2025 Aug 21
2025-Aug-21|2025/Aug/21|10:30 21/08/2025|10:30 2025-08-21|2025-08-21T10|2025-08-21 10|21st August 2025|August 21st, 2025
Aug 21st 2025|21-Aug-25|21 Aug 25|Aug 21, 25|Aug 21 25|2025.08|10/2025|2025-08-21 10:00:00 EST|2025-08-21 10:00:00 PST
2025-08-21 10:00:00 CET|2025-08-21 10:00:00+5|2025-08-21 10:00:00 +5|2025-08-21T10:00:00+05|2025-08-21 10:00:00-0530|01/02/03
13/02/03|31/12/99|12/31/68|12/31/69|12/31/70|1-1-75|01-02-76|01/02/77|30-Jun-69|30-Jun-68|30-Jun-75|30-Jun-76|30 June 77|June 25
25 June|Aug|2025 08 21|21 08 2025|08 21 2025|2025, Aug 21|Thursday, 21 August 2025|Thu 21 Aug 2025 10:30
Thu Aug 21 10:30:00 UTC 2025|Thu Aug 21 10:30:00 EST 2025|21.08.25|08.21.25|21.8.2025|2025.8.21|2025.8|8.2025|08-2025|8-2025
2025-8|2025/8|13/2025|2025/13|2025-08-21 10:30 PM|2025-08-21 10PM|2025-08-21 10 PM|10PM 2025-08-21|Aug 21 2025 10pm|2nd Jan 2025
3rd of March 2025|21 of August 2025|August 21 of 2025|1st|2025-08-21T103000|2025-08-21T1030|20250821T10|20250821T103000Z
20250821 1030|20250821 10|250821|20250|200|2025-08-21 10:30:00.123456789|2025-08-21 24:00:00|2025-08-21 25:00|2025-02-30
30/02/2025|02/30/2025|Feb 30 2025|2025-08-21,10:30|21/08/2025, 10:30|8/21/25 10:30|8/21/25, 10:30 AM|21/8/25 10:30|Aug-21-2025
Aug/21/2025|21/Aug/2025|21/Aug/2025:10:30:00 +0000|Aug.21.2025|Aug. 21, 2025|Sept 21 2025|2025 August|2025-Aug|Aug-2025|Aug-25
25-Aug|2025年8月21日|21 août 2025|2025-08-21 GMT|2025-08-21Z|2025-08-21+05:00|August 21, 2025 at 10:30 AM|2025-08-21 at 10:30
0025-08-21|1500-01-01|2300-01-01|99/08/21|00/01/02|32/01/02|2025-8-1|2025-08-21 10:30:00 UTC+2|2025-08-21 10:30 GMT+2|12/2025/08
8/2025/21|5/6/07|15/6/07|6/15/07|07/15/06|2007/15/06|2007-15-06|2007 15 06|15-06-2007|Sunday|T10|1 2 3|1.2.3|1.2.2003|01.02.03
13.02.03|2003.02.01|12.31.2003|20251301|20250230 1030|202508212530|991231|311299""".replace("\n", "|").split("|")


def test_more_shapes_match_pandas(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(MORE_SHAPES)], "i int, s string")
    staged = [r.o for r in T.with_first_date(df, "o", ["s"], fmt="yyyy-MM-dd").orderBy("i").collect()]
    column = [r.o for r in df.select("i", F.date_format(T.value_to_date("s"), "yyyy-MM-dd").alias("o")).orderBy("i").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = [pd.to_datetime(v, errors="coerce") for v in MORE_SHAPES]
    want = [None if pd.isna(w) else w.strftime("%Y-%m-%d") for w in want]
    assert [x for x in zip(MORE_SHAPES, staged, want) if x[1] != x[2]] == []
    assert column == staged


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=1_000_000_000, max_value=9_000_000_000), min_size=1, max_size=8))
def test_epochs_match_pandas(spark, secs):
    values = [str(s) for s in secs] + [str(s * 1000 + 123) for s in secs]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r.o for r in T.with_first_date(df, "o", ["s"], fmt="yyyy-MM-dd").orderBy("i").collect()]
    for v, g in zip(values, got):
        x = pd.to_numeric(v)
        want = pd.to_datetime(x, unit="ms" if x >= 1e12 else "s", errors="coerce")
        assert g == (None if pd.isna(want) else want.strftime("%Y-%m-%d")), (v, g, want)
