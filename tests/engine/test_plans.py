"""Plans: what reaches the scan, what stays in the JVM, where shuffles are."""

import re

import pytest

from timberline import api
from timberline.sources.records import promote


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "e")
    spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id % 7 AS user, concat('k', id % 3) AS kind, id * 1.5D AS value, concat('msg ', id) AS raw FROM range(1000)").write.parquet(path)
    return lambda raw=None: promote(spark.read.parquet(path).drop(*([] if raw else ["raw"])), "ts", "id", raw, extract="auto" if raw else "none")


def plan(records, q):
    df = api.search(records, q).dataframe()
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(table):
    p = plan(table(), "start=2024-01-01T00:01:00Z value>=30 user!=3 | stats count as n by kind")
    pushed = re.search(r"PushedFilters: \[(.*)\]", p)[1]
    assert "GreaterThanOrEqual(value,30.0)" in pushed and "Not(EqualTo(user,3))" in pushed and "GreaterThanOrEqual(ts," in pushed
    assert re.search(r"ReadSchema: struct<(.*)>", p)[1].count(":") == 4
    assert p.count("Exchange hashpartitioning") + p.count("Exchange (") >= 1 and "Python" not in p


def test_python_only_on_demand(table):
    assert "ArrowEvalPython" not in plan(table("raw"), "msg | stats count as n")
    assert "ArrowEvalPython" in plan(table("raw"), "x=1 | stats count as n")
    assert "ArrowEvalPython" not in plan(table(), "nosuch=1 OR len(kind) > 1 | eval y = value * 2 | stats sum(y) as s by kind")


def test_top_k_needs_no_global_sort(table):
    p = plan(table(), "| sort -value | head 5")
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p
    assert "TakeOrderedAndProject" in plan(table(), "| tail 5")
