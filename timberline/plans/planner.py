"""A parsed query over records to a frame, operator by operator."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from timberline.lang import ast as A
from timberline.lang.directives import Directives
from timberline.lang.errors import QueryError
from timberline.lang.printer import filter_text, pipe_text
from timberline.operators import stats as stats_op
from timberline.operators import timechart as timechart_op
from timberline.operators import transforms as X
from timberline.operators.lookup import Lookup, lookup
from timberline.plans.frame import Frame, start
from timberline.plans.predicates import compile_filter
from timberline.sources.records import Records

_SIMPLE = {A.Where: X.where, A.Eval: X.evaluate, A.Sort: X.sort, A.Head: X.head, A.Tail: X.tail, A.Slice: X.cut, A.Rename: X.rename, A.Fields: X.fields}
ROW_WISE = (A.Where, A.Eval, A.Rename, A.Fields, A.Lookup)


def reads_fields(f: object) -> bool:
    """Whether a filter looks at anything but raw text."""
    match f:
        case A.Compare() | A.ExprCompare():
            return True
        case A.Not(t):
            return reads_fields(t)
        case A.And(ts) | A.Or(ts):
            return any(map(reads_fields, ts))
    return False


def demand(query: A.Query) -> bool:
    """Whether the query may need fields from inside messages."""
    if query.filter is not None and reads_fields(query.filter):
        return True
    for op in query.pipes:
        match op:
            case A.Where(f):
                if reads_fields(f):
                    return True
            case A.Stats(aggs, groups):
                return any(a.arg is not None for a in aggs) or any(isinstance(g, str) or g.field for g in groups)
            case A.Timechart(_, by):
                return by is not None
            case A.Head() | A.Tail() | A.Slice() | A.Chart() | A.Export() | A.Dedup():
                continue
            case _:
                return True
    return False


def bounded(frame: Frame, d: Directives) -> Frame:
    """Time bounds as plain comparisons of columns, so they prune files and row groups."""
    df = frame.df
    for column, low, high in (("ingest_ts", d.start, d.end), ("source_ts", d.source_start, d.source_end)):
        if column not in df.columns:
            if low or high:
                df = df.where(F.lit(False))
            continue
        kind = dict(df.dtypes)[column]
        if low:
            df = df.where(F.col(column) >= F.lit(low).cast("timestamp").cast(kind))
        if high:
            df = df.where(F.col(column) < F.lit(high).cast("timestamp").cast(kind))
    if d.pos is not None:
        df = df.where(F.col("pos") == d.pos) if "pos" in df.columns else df.where(F.lit(False))
    return frame.with_df(df)


def selected(f: object, frame: Frame) -> object:
    """Vault and chunk terms are columns of their own: the scan prunes by them wherever they stand."""
    match f:
        case A.Compare(str(k), op, v) if k.lower() in ("vault_id", "chunk", "chunk_id", "vault"):
            column = "vault_id" if k.lower() == "vault_id" else "chunk_id" if k.lower() in ("chunk", "chunk_id") else None
            if column and frame.has(column) and op in ("=", "!=") and isinstance(v, str):
                return _Column(F.col(column) == v if op == "=" else F.col(column) != v)
            return f
        case A.Not(t):
            return A.Not(selected(t, frame))
        case A.And(ts):
            return A.And(tuple(selected(t, frame) for t in ts))
        case A.Or(ts):
            return A.Or(tuple(selected(t, frame) for t in ts))
    return f


class _Column:
    """A filter term that is a column already."""

    def __init__(self, column) -> None:
        self.column = column


def filtered(frame: Frame, f: object) -> Frame:
    if f is None:
        return frame
    return frame.with_df(frame.df.filter(_compiled(selected(f, frame), frame)))


def _compiled(f: object, frame: Frame):
    match f:
        case _Column():
            return f.column
        case A.Not(t):
            return ~F.coalesce(_compiled(t, frame), F.lit(False))
        case A.And(ts) | A.Or(ts):
            out = _compiled(ts[0], frame)
            for t in ts[1:]:
                out = out & _compiled(t, frame) if isinstance(f, A.And) else out | _compiled(t, frame)
            return out
    return compile_filter(f, frame)


def plan(records: Records, query: A.Query, d: Directives, registry: dict[str, Lookup]) -> Frame:
    frame = start(records, demand(query), d.order, d.reverse)
    frame = filtered(bounded(frame, d), query.filter)
    for op in query.pipes:
        frame = apply(frame, op, d, registry)
    return frame


def apply(frame: Frame, op: object, d: Directives, registry: dict[str, Lookup]) -> Frame:
    match op:
        case A.Stats():
            return stats_op.stats(frame, op, d.start, d.end)
        case A.Timechart():
            if not frame.records:
                raise QueryError("timechart works on records")
            return timechart_op.timechart(frame, op, d.start, d.end, d.order)
        case A.Lookup():
            return lookup(frame, op, registry)
        case A.Dedup():
            return X.dedup(frame, op)
        case A.Raw():
            return X.raw_table(frame)
        case A.Chart() | A.Export():
            return frame
    return _SIMPLE[type(op)](frame, op)


def limited(frame: Frame, limit: int | None) -> Frame:
    return frame if limit is None else X.head(frame, A.Head(limit))


def describe(query: A.Query, d: Directives) -> str:
    """The logical plan, one line an operator."""
    lines = []
    bounds = [f"{n} {s} {t.isoformat()}" for n, s, t in (("ingest_ts", ">=", d.start), ("ingest_ts", "<", d.end), ("source_ts", ">=", d.source_start), ("source_ts", "<", d.source_end)) if t]
    lines.append("scan" + (f" [{', '.join(bounds)}]" if bounds else "") + f" order {d.order}{' descending' if d.reverse else ''}")
    lines.append("  fields from raw: " + ("yes" if demand(query) else "no"))
    if query.filter is not None:
        lines.append(f"filter {filter_text(query.filter)}")
    for op in query.pipes:
        kind = "row by row" if isinstance(op, ROW_WISE) else "aggregation" if isinstance(op, (A.Stats, A.Timechart)) else "hint" if isinstance(op, A.Chart) else "ordered"
        lines.append(f"{pipe_text(op)}  ({kind})")
    if d.limit is not None:
        lines.append(f"limit {d.limit}")
    return "\n".join(lines)


def field_names(query: A.Query, base: list[str]) -> list[str]:
    """Names of the fields visible after a query, from those before it."""
    names = list(base)
    for op in query.pipes:
        match op:
            case A.Eval(xs):
                names += [n for n, _ in xs if n not in names]
            case A.Rename(pairs):
                for a, b in pairs:
                    names = [b if n == a else n for n in names if n != b or a not in names]
            case A.Fields(ns, drop):
                names = [n for n in names if n not in ns] if drop else [n for n in ns if n in names]
            case A.Stats(aggs, groups):
                names = [g if isinstance(g, str) else stats_op.TIME for g in groups] + [a.alias for a in aggs]
            case A.Timechart(_, by):
                names = [stats_op.TIME, *([by] if by else []), "count"]
    return names


def narrowed(d: Directives, start_at: datetime | None = None, end_at: datetime | None = None) -> Directives:
    return replace(d, start=start_at or d.start, end=end_at or d.end)
