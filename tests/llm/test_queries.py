"""The registered queries on the small tables, against SQL where there is some."""

import os
from pathlib import Path

import pytest

from timberline.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("op2_token_counts", "op3_url_filter")])
def test_one_row_a_document(spark, name):
    df = QUERIES[name](spark, SF)
    ids = {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
