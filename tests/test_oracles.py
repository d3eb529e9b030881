"""Every ledger query against its SQL in DuckDB, on the same Parquet tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from tallyspark.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    """A value that sorts and compares alike from both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    got = QUERIES[name](spark, SF)
    expected = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in got.collect())
    at = [expected.columns.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in expected.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
