"""Every named query against DuckDB on the small tables, as the driver does."""

import os
from pathlib import Path

import pytest

from timberline import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = canon([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        want, names = canon(found.fetchall(), [d[0] for d in found.description])
        assert columns == names
        assert rows == want
    else:
        assert rows
