"""Every registered narration query runs, and gives what its SQL gives."""

import math

import duckdb
import pytest

from inkstream import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    found = registry.QUERIES[name](spark, small)
    rows = [tuple(r) for r in found.collect()]
    assert rows, "no rows"
    if name in registry.ORACLES:
        expected = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in expected.description]
        assert sorted(found.columns) == sorted(columns)
        a, b = rows_of(found.columns, rows), rows_of(columns, expected.fetchall())
        assert len(a) == len(b), (len(a), len(b))
        assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:5]
