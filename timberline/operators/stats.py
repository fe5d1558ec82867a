"""stats: grouped aggregates, with time bins and their gaps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.values import Value
from timberline.lang import ast as A
from timberline.plans.expressions import compile_expression
from timberline.plans.frame import Frame, Order

#: Bins are aligned to year 1, not to 1970.
YEAR_1_US = 62_135_596_800_000_000
UNITS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
TIME = "_time"


def width_us(duration: str) -> int:
    return int(float(duration[:-1]) * UNITS[duration[-1]])


def bin_us(us: Column, width: int) -> Column:
    """Start of the bin of an instant in microseconds, in whole numbers throughout."""
    shifted = us + F.lit(YEAR_1_US)
    return shifted - F.pmod(shifted, F.lit(width)) - F.lit(YEAR_1_US)


def as_time(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def instant_us(frame: Frame, name: str | None) -> Column:
    """Microseconds of write_ts, ingest_ts, source_ts, or a field with epoch seconds or RFC 3339 text."""
    name = name or "write_ts"
    if name in ("write_ts", "ingest_ts", "source_ts"):
        return F.unix_micros(F.col(name).cast("timestamp")) if frame.has(name) else F.lit(None).cast("bigint")
    value = frame.value(name)
    if name in frame.fields and isinstance(frame.df.schema[frame.fields[name]].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(f"`{frame.fields[name]}`").cast("timestamp"))
    seconds = (value.number() * 1e6).try_cast("bigint")
    return seconds if value.numeric else F.coalesce(seconds, F.unix_micros(F.try_to_timestamp(value.text())))


def reversed_key(c: Column, kind: T.DataType) -> list[Column]:
    """Columns whose ascending order is c's descending one, nulls last as in Order."""
    rest: list[Column]
    match kind:
        case T.StructType():
            rest = [x for f in kind.fields for x in reversed_key(c[f.name], f.dataType)]
        case T.TimestampType() | T.TimestampNTZType():
            rest = [F.bitwise_not(F.unix_micros(c.cast("timestamp")))]
        case T.DoubleType() | T.FloatType():
            rest = [~F.isnan(c), -c]
        case T.DecimalType():
            rest = [-c]
        case T.IntegralType():
            rest = [F.bitwise_not(c)]
        case _:
            # inverted bytes with an end mark above all of them: a longer text comes before its beginning
            rest = [F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    return [c.isNull(), *rest]


def order_key(frame: Frame) -> Column:
    """A value that orders rows as the frame does, for min_by and max_by; no row is numbered for it."""
    if not frame.order:
        return F.lit(0)
    parts = []
    for o in frame.order:
        c = F.col(f"`{o.column}`")
        parts += reversed_key(c, frame.df.schema[o.column].dataType) if o.descending else [c]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(parts)])


def _aggregate(a: A.Aggregate, value: Value | None, order: Column) -> Column:
    if value is None:
        return F.count(F.lit(1))
    n, present = value.number().cast("double"), value.column.isNotNull()
    real = F.when(~F.isnan(n), n)
    match a.func:
        case "count":
            return F.count(value.column)
        case "sum":
            return F.sum(n)
        case "avg":
            return F.avg(n)
        case "min":
            return F.min(real)
        case "max":
            return F.max(real)
        case "dcount":
            return F.count_distinct(value.column)
        case "median":
            return F.median(n)
        case "first":
            return F.min_by(value.column, F.when(present, order))
        case "last":
            return F.max_by(value.column, F.when(present, order))
    raise TypeError(a)


def stats(frame: Frame, op: A.Stats, start: datetime | None = None, end: datetime | None = None) -> Frame:
    df, groups, names, width = frame.df, [], [], 0
    for i, g in enumerate(op.groups):
        at = f"__g{i}"
        if isinstance(g, A.Bin):
            width = width_us(g.duration)
            df = df.withColumn(at, bin_us(instant_us(frame, g.field), width)).where(F.col(at).isNotNull())
            names.append(TIME)
        else:
            v = frame.value(g)
            df = df.withColumn(at, v.column if v.numeric else F.coalesce(v.column, F.lit("")))
            names.append(g)
        groups.append(at)
    frame = frame.with_df(df)
    args = [compile_expression(a.arg, frame) if a.arg is not None else None for a in op.aggregates]
    order: Column = F.lit(0)
    if any(a.func in ("first", "last", "values") for a in op.aggregates):
        order = order_key(frame)
    plain = [_aggregate(a, v, order).alias(a.alias) for a, v in zip(op.aggregates, args) if a.func != "values"]
    out = df.groupBy(*groups).agg(*plain) if plain else None
    for a, v in zip(op.aggregates, args):
        if a.func == "values":
            out = _with_values(df, groups, a.alias, v, order, out)
    if width:
        out = fill(out, groups, names, op.aggregates, width, start, end)
    columns = [(as_time(F.col(g)) if n == TIME and width else F.col(g)).alias(n) for g, n in zip(groups, names)]
    out = out.select(*columns, *[F.col(f"`{a.alias}`") for a in op.aggregates])
    visible = {c: c for c in out.columns}
    return Frame(out, "table", visible, tuple(Order(n) for n in names))


def _with_values(df: DataFrame, groups: list[str], alias: str, value: Value, order: Column, out: DataFrame | None) -> DataFrame:
    """Adds distinct texts in first-seen order; each group's distinct values are found before any is listed."""
    seen = df.select(*groups, value.text().alias("__v"), order.alias("__o")).where("__v is not null")
    seen = seen.groupBy(*groups, "__v").agg(F.min("__o").alias("__o"))
    listed = seen.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]), ", ").alias(alias))
    if out is None:
        every = df.select(*groups).distinct() if groups else None
        if every is None:
            return listed.withColumn(alias, F.when(F.col(alias) != "", F.col(alias)))
        out = every
    if not groups:
        return out.join(listed.withColumn(alias, F.when(F.col(alias) != "", F.col(alias))), how="cross")
    on = None
    right = listed.select(*[F.col(g).alias(f"__r{g}") for g in groups], alias)
    for g in groups:
        same = F.col(g).eqNullSafe(F.col(f"__r{g}"))
        on = same if on is None else on & same
    return out.join(right, on, "left").drop(*[f"__r{g}" for g in groups])


def fill(out: DataFrame, groups: list[str], names: list[str], aggregates: tuple, width: int, start: datetime | None, end: datetime | None) -> DataFrame:
    """Every group gets every bin from start to end (end's included); empty ones count 0."""
    at = groups[names.index(TIME)]
    others = [g for g in groups if g != at]
    low = bin_us(F.unix_micros(F.lit(start).cast("timestamp")), width) if start else None
    high = bin_us(F.unix_micros(F.lit(end).cast("timestamp")), width) if end else None
    bounds = out.agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    bounds = bounds.select((low if low is not None else F.col("__lo")).alias("__lo"), (high if high is not None else F.col("__hi")).alias("__hi")).where("__lo <= __hi")
    bins = bounds.select(F.explode(F.sequence("__lo", "__hi", F.lit(width))).alias(at))
    # one row of bounds, so this is bins times groups: the result's own size
    grid = out.select(*others).distinct().join(bins, how="cross") if others else bins
    left, right = grid.alias("l"), out.alias("r")
    on = F.col(f"l.{at}") == F.col(f"r.{at}")
    for g in others:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    values = [(F.coalesce(F.col(f"r.`{a.alias}`"), F.lit(0)) if a.func in ("count", "dcount") else F.col(f"r.`{a.alias}`")).alias(a.alias) for a in aggregates]
    return left.join(right, on, "left").select(*[F.col(f"l.{g}") for g in groups], *values)
