"""Every query of the engine against its SQL, run by DuckDB on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from codeloom.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(("nan" if isinstance(r[k], float) and math.isnan(r[k]) else round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = plain(got.collect(), got.columns)
    assert [repr(x) for x in rows] == [repr(x) for x in plain([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()], want.columns)]
    assert rows or name in ("secrets_scan",)
