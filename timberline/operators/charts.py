"""Chart hints: whether a result table suits a chart, decided by one aggregation over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.lang import ast as A
from timberline.plans.frame import Frame

TABLE = "table"
COUNTRY = r"\A[A-Z]{2}\z"
TIMELIKE = r"\A\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?\z"


def _numeric(frame: Frame, name: str) -> Column:
    """1 if any row isn't a number (empty cells don't count)."""
    v = frame.value(name)
    if v.numeric:
        return F.lit(0)
    text = v.text()
    return F.max(F.when(text.isNotNull() & (text != "") & v.number().isNull(), 1).otherwise(0))


def _is_time(frame: Frame, name: str) -> Column:
    kind = frame.df.schema[frame.fields[name]].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(0)
    return F.max(F.when(frame.value(name).text().rlike(TIMELIKE), 0).otherwise(1))


def chart_type(frame: Frame, op: A.Chart | None) -> str:
    """The chart's name, or "table" if the result doesn't suit it; without op what suits it by itself."""
    names = list(frame.fields)
    if frame.records or not names:
        return TABLE
    facts = {"rows": F.count(F.lit(1)), "bad_last": _numeric(frame, names[-1]), "bad_time": _is_time(frame, names[0])}
    for i, name in enumerate(names[:2]):
        facts[f"n{i}"] = F.count_distinct(frame.value(name).text())
    if op is not None and op.kind in ("scatter", "points", "choropleth"):
        if any(c not in frame.fields for c in op.columns):
            return TABLE
        values = [frame.value(c) for c in op.columns]
        if op.kind == "choropleth":
            text = values[0].text()
            facts["bad_x"] = F.max(F.when((text != "") & ~text.rlike(COUNTRY), 1).otherwise(0))
        else:
            empty = [v.text().isNull() | (v.text() == "") for v in values]
            wrong = values[0].number().isNull() | values[1].number().isNull()
            skip = (empty[0] | empty[1]) if op.kind == "points" else F.lit(False)
            facts["bad_x"] = F.max(F.when(wrong & ~skip, 1).otherwise(0))
            facts["pairs"] = F.sum(F.when(~wrong, 1).otherwise(0))
    r = frame.df.agg(*[c.alias(k) for k, c in facts.items()]).first()
    rows, columns = r["rows"], len(names)
    last = not r["bad_last"]
    if op is None:
        if columns == 2 and 2 <= rows <= 12 and last:
            return "donut"
        if columns == 3 and rows >= 4 and last and 2 <= r["n0"] <= 30 and 2 <= r["n1"] <= 30:
            return "heatmap"
        return TABLE
    fits = {
        "linechart": lambda: columns >= 2 and rows >= 2 and not r["bad_time"] and last,
        "barchart": lambda: columns >= 2 and rows >= 2 and last,
        "donut": lambda: columns == 2 and rows >= 2 and last,
        "heatmap": lambda: columns == 3 and rows >= 4 and last,
        "scatter": lambda: rows >= 2 and not r["bad_x"],
        "points": lambda: r["pairs"] is not None and r["pairs"] >= 2 and not r["bad_x"],
        "choropleth": lambda: rows >= 1 and not r["bad_x"],
    }[op.kind]
    return op.kind if fits() else TABLE
