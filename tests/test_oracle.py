"""Every query that has a DuckDB counterpart gives its rows."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.ORACLE_SQL[name])
    wanted = rows([d[0] for d in cur.description], cur.fetchall())
    assert found == wanted


def test_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 180
