"""Every query with an oracle gives DuckDB's rows."""

import decimal
import math

import duckdb
import pytest

from acrelane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want
