"""Record and table transforms: frame in, frame out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from timberline.functions.values import Value
from timberline.lang import ast as A
from timberline.lang.directives import duration
from timberline.lang.errors import QueryError
from timberline.plans.expressions import compile_expression
from timberline.plans.frame import INSTANTS, Frame, Order
from timberline.plans.predicates import compile_filter


def fresh(frame: Frame, name: str) -> str:
    return f"c{len(frame.df.columns)}_{name}"


def surely_missing(frame: Frame, name: str) -> bool:
    """Whether no row can have the field."""
    if name in frame.fields:
        return False
    return not frame.records or frame.closed or name in frame.hidden or not (frame.has("attrs") or frame.has("pairs") or frame.has(name))


def _merged(new: Value, old: Value) -> Value:
    if new.numeric and old.numeric:
        return Value(F.coalesce(new.column.cast("double"), old.column.cast("double")), True)
    return Value(F.coalesce(new.text(), old.text()))


def assign(frame: Frame, name: str, value: Value) -> Frame:
    """The frame with a field; rows where value is missing keep what they had."""
    if not surely_missing(frame, name):
        value = _merged(value, frame.value(name))
    column = value.column
    if not frame.records and not value.numeric:
        column = F.coalesce(column, F.lit(""))
    at = fresh(frame, name)
    return frame.with_df(frame.df.withColumn(at, column), fields={**frame.fields, name: at}, hidden=frame.hidden - {name})


def materialized(frame: Frame, name: str) -> Frame:
    """The frame with the field as a column of its own."""
    if name in frame.fields or surely_missing(frame, name):
        return frame
    at = fresh(frame, name)
    return frame.with_df(frame.df.withColumn(at, frame.value(name).column), fields={**frame.fields, name: at})


def where(frame: Frame, op: A.Where) -> Frame:
    return frame.with_df(frame.df.filter(compile_filter(op.filter, frame)))


def evaluate(frame: Frame, op: A.Eval) -> Frame:
    for name, e in op.assignments:
        frame = assign(frame, name, compile_expression(e, frame))
    return frame


def sort_key(value: Value) -> Column:
    """Empty or missing first, then numbers by size, then text by bytes."""
    text, n = value.text(), value.number()
    rank = F.when(text.isNull() | (text == ""), 0).when(n.isNotNull(), 1).otherwise(2)
    return F.struct(rank.alias("r"), F.when(rank == 1, n).alias("n"), F.when(rank == 2, text).alias("t"))


def sort(frame: Frame, op: A.Sort) -> Frame:
    """New keys first; the order so far breaks ties, as a stable sort does."""
    keys = []
    for key in op.keys:
        value = frame.value(key.name)
        if value.numeric and key.name in frame.fields:
            keys.append(Order(frame.fields[key.name], key.descending))
            continue
        at = fresh(frame, f"sort_{key.name}")
        frame = frame.with_df(frame.df.withColumn(at, sort_key(value)))
        keys.append(Order(at, key.descending))
    return replace(frame, order=(*keys, *frame.order), sorted=True)


def ordered(frame: Frame, flip: bool = False):
    keys = [o.key(flip) for o in frame.order]
    return frame.df.orderBy(*keys) if keys else frame.df


def head(frame: Frame, op: A.Head) -> Frame:
    return frame.with_df(ordered(frame).limit(op.n))


def tail(frame: Frame, op: A.Tail) -> Frame:
    """The last rows, by a top-k in reverse; their order stays."""
    return frame.with_df(ordered(frame, flip=True).limit(op.n))


def cut(frame: Frame, op: A.Slice) -> Frame:
    """Rows first to last, counted from 1."""
    return frame.with_df(ordered(frame).limit(op.last).offset(op.first - 1))


def rename(frame: Frame, op: A.Rename) -> Frame:
    for old, new in op.pairs:
        if old == new or surely_missing(frame, old):
            continue
        frame = materialized(frame, old)
        column = frame.fields[old]
        left = {k: v for k, v in frame.fields.items() if k != old}
        if frame.records and not surely_missing(frame, new):
            frame = assign(replace(frame, fields=frame.fields), new, frame.column(column))
            left = {k: v for k, v in frame.fields.items() if k != old}
            frame = replace(frame, fields=left, hidden=frame.hidden | {old})
        else:
            names = list(frame.fields)
            left = {new if k == old else k: frame.fields[k] for k in names if k != new}
            frame = replace(frame, fields=left, hidden=(frame.hidden | {old}) - {new})
    return frame


def fields(frame: Frame, op: A.Fields) -> Frame:
    """Keep or drop fields; a record's times, raw and identity are no fields and stay."""
    if op.drop:
        return replace(frame, fields={k: v for k, v in frame.fields.items() if k not in op.names}, hidden=frame.hidden | frozenset(op.names))
    for name in op.names:
        frame = materialized(frame, name)
    kept = {n: frame.fields[n] for n in op.names if n in frame.fields}
    return replace(frame, fields=kept, closed=True)


def dedup(frame: Frame, op: A.Dedup) -> Frame:
    """Of records with one identity, drop those written at most a window after the last kept one.

    Identities are compared null-safe. A record later than all before it by more than the window is kept and
    starts a chain; what is within the window of its chain's start is dropped. Both take running aggregates only. Others
    (retries that go on for longer than the window) hang on the last one kept: they alone are folded, chain by chain.
    """
    try:
        window = max(int(duration(op.window).total_seconds() * 1e6), 0) if op.window else 1_000_000
    except QueryError:
        window = 1_000_000
    window = window or 1_000_000
    identity = [c for c in ("ingester_id", "node_id", "ingest_ts", "ingest_seq") if c in frame.df.columns]
    order = Window.partitionBy(*identity).orderBy(*[o.key() for o in frame.order], F.col("write_ts"))
    df = frame.df.withColumn("__us", F.unix_micros(F.col("write_ts").cast("timestamp")))
    here, past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("__us").over(past)
    df = df.withColumn("__first", top.isNull() | (F.col("__us") - top > window))
    df = df.withColumn("__from", F.last(F.when(F.col("__first"), F.col("__us")), ignorenulls=True).over(here))
    df = df.withColumn("__open", ~F.col("__first") & (F.col("__us") - F.col("__from") > window))
    df = df.where("__first OR __open").withColumn("__chain", F.sum(F.col("__first").cast("bigint")).over(here))
    # an array over first and open records of a chain: one record, but for chains with open ones
    chain = Window.partitionBy(*identity, "__chain").orderBy(*[o.key() for o in frame.order], F.col("write_ts"))
    last = F.aggregate(
        F.collect_list("__us").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        F.struct(F.lit(None).cast("bigint").alias("kept"), F.lit(True).alias("keep")),
        lambda s, x: F.struct(
            F.when(s["kept"].isNull() | (x - s["kept"] > window), x).otherwise(s["kept"]).alias("kept"),
            (s["kept"].isNull() | (x - s["kept"] > window)).alias("keep"),
        ),
    )
    df = df.withColumn("__keep", last["keep"]).where("__keep").drop("__us", "__first", "__from", "__open", "__chain", "__keep")
    return frame.with_df(df)


MOST_COLUMNS = 5_000


def raw_table(frame: Frame) -> Frame:
    """A flat table: times, all fields in name order, raw. Open fields take a job that lists their names."""
    times = [c for c in ("write_ts", "ingest_ts", "source_ts") if frame.has(c)]
    names = set(frame.fields)
    if frame.records and not frame.closed:
        found = []
        if frame.has("attrs"):
            found.append(frame.df.select(F.explode(F.map_keys("attrs")).alias("k")))
        if frame.has("pairs"):
            found.append(frame.df.select(F.explode("pairs").alias("p")).where("p.s < 2").select(F.col("p.k").alias("k")))
        for keys in found:
            names |= {r["k"] for r in keys.distinct().limit(MOST_COLUMNS + 1).collect()}
        if len(names) > MOST_COLUMNS:
            raise QueryError(f"more than {MOST_COLUMNS} fields can't be columns of a table: name those wanted with fields")
    names -= frame.hidden | set(INSTANTS) | {"raw"}
    columns = [F.col(c).alias(c) for c in times]
    for n in sorted(names):
        v = frame.value(n)
        columns.append((v.column if v.numeric else F.coalesce(v.column, F.lit(""))).alias(n))
    if frame.has("raw"):
        columns.append(F.col("raw").alias("raw"))
    keys = [F.col(f"`{o.column}`").alias(f"__o{i}") for i, o in enumerate(frame.order)]
    out = frame.df.select(*columns, *keys)
    visible = {c: c for c in out.columns if not c.startswith("__o")}
    return Frame(out, "table", visible, tuple(Order(f"__o{i}", o.descending) for i, o in enumerate(frame.order)), sorted=frame.sorted)
