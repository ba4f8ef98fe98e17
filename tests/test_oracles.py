"""Registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("op", "pipeline", "v02", "v03", "v04", "v05", "v06", "v08", "v09", "r06", "r12", "r15", "r17", "r18", "r19", "g04", "g11_verbatim", "s10", "l07", "g15")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v).lower() if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SLOW) or n == "g11_verbatim_fixture"])
def test_query_equals_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, str(SF))
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(result.columns)
    columns = sorted(frame.columns)
    at = [result.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
