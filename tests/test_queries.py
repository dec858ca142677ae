"""Every registered query against its DuckDB oracle at sf0.001, and the entry point."""
import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from msgaudit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"binary_hash", "train_score", "hash_appendix", "network_score"}


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q)
    assert set(QUERIES) - set(o) == ROWS_ONLY


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"platform", "total", "hate", "safe", "hate_pct", "safe_pct"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(srows, df.columns) == digest(drows, dcols)


DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_types_match_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rel = duck.sql(E.oracle_sql()[name])
    ours = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert ours == theirs


def test_ordered_relations_keep_their_order(spark):
    q = E.queries()
    balance = [r["count"] for r in q["class_balance"](spark, SF).collect()]
    assert balance == sorted(balance, reverse=True)
    listing = [(r["archive"], r["member"]) for r in q["tar_members"](spark, SF).collect()]
    assert listing == sorted(listing) and len(listing) > 1
    ranks = [r["rank"] for r in q["flagged_topn"](spark, SF).collect()]
    assert ranks and ranks == list(range(1, len(ranks) + 1))


def test_hash_appendix_covers_the_table_files(spark):
    import hashlib

    want = {(f, hashlib.sha256(open(os.path.join(SF, f), "rb").read()).hexdigest()) for f in os.listdir(SF) if f.endswith(".parquet")}
    got = {(r["database"].replace("​", ""), r["hash"].replace("​", "")) for r in E.queries()["hash_appendix"](spark, SF).collect()}
    assert got == want


def test_a_model_as_a_table_agrees_with_duckdb(spark, duck):
    ours = {r["doc_id"]: (r["margin"], r["model_label"], r["model_confidence"]) for r in E.queries()["score_relational"](spark, SF).collect()}
    theirs = {r[0]: r[1:] for r in duck.sql(E.oracle_sql()["score_relational"]).select("doc_id", "margin", "model_label", "model_confidence").fetchall()}
    assert ours == theirs and len({v[0] for v in ours.values()}) > 20
