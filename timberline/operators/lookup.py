"""lookup: left-outer enrichment by tables, address ranges or functions.

Tables join by key, without a hint: Spark broadcasts a side by its size in bytes, as planned or as measured while
the query runs, and splits skewed keys. Ranges join by the address' leading bits, so that no join is by inequality alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.lang import ast as A
from timberline.plans.frame import Frame

PREFIX_BITS = 16


@dataclass(frozen=True)
class Table:
    """Rows by key columns; of equal keys the first row (in file or list order) counts."""

    df: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]
    unique: bool = False
    #: columns of df that order its rows
    order: tuple[str, ...] = ()

    @property
    def suffixes(self) -> tuple[str, ...]:
        return self.values

    def rows(self) -> DataFrame:
        if self.unique:
            return self.df.select(*self.keys, *self.values)
        numbered = self.df.withColumn("__n", F.struct(*self.order, F.monotonically_increasing_id().alias("__id")))
        first = numbered.groupBy(*self.keys).agg(F.min_by(F.struct(*self.values), "__n").alias("v"))
        return first.select(*self.keys, "v.*")


@dataclass(frozen=True)
class Ranges:
    """IPv4 ranges lo to hi (whole numbers, both included, disjoint) with values."""

    df: DataFrame
    lo: str
    hi: str
    values: tuple[str, ...]

    @property
    def suffixes(self) -> tuple[str, ...]:
        return self.values


@dataclass(frozen=True)
class Function:
    """A vectorized function of the parameters' texts to a frame of suffix columns; null rows are misses."""

    run: Callable[..., pd.DataFrame]
    suffixes: tuple[str, ...]
    parameters: int = 1


Lookup = Table | Ranges | Function


def ipv4(text: Column) -> Column:
    """Dotted text as a number, null if it isn't an address."""
    part = lambda i: F.regexp_extract(text, r"\A(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z", i).try_cast("bigint")
    parts = [part(i) for i in range(1, 5)]
    fits = parts[0] <= 255
    for p in parts[1:]:
        fits = fits & (p <= 255)
    return F.when(fits, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def _join_table(frame: Frame, table: Table, names: tuple[str, ...], prefix: str) -> Frame:
    rows = table.rows()
    side = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(table.keys)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(table.values)])
    on: Column | None = None
    for i, name in enumerate(names):
        value, key = frame.value(name), F.col(f"__k{i}")
        typed = value.numeric and isinstance(rows.schema[table.keys[i]].dataType, T.NumericType)
        same = value.column == key if typed else value.text() == Frame(side, "table", {}).column(f"__k{i}").text()
        on = same if on is None else on & same
    df = frame.df.join(side, on, "left").drop(*[f"__k{i}" for i in range(len(table.keys))])
    return _named(frame.with_df(df), table.values, [f"__v{i}" for i in range(len(table.values))], prefix)


def _join_ranges(frame: Frame, ranges: Ranges, name: str, prefix: str) -> Frame:
    shift = 32 - PREFIX_BITS
    side = ranges.df.select(
        F.col(ranges.lo).cast("bigint").alias("__lo"),
        F.col(ranges.hi).cast("bigint").alias("__hi"),
        *[F.col(v).alias(f"__v{i}") for i, v in enumerate(ranges.values)],
    )
    side = side.withColumn("__p", F.explode(F.sequence(F.shiftright("__lo", shift), F.shiftright("__hi", shift))))
    df = frame.df.withColumn("__ip", ipv4(frame.value(name).text()))
    on = (F.shiftright("__ip", shift) == F.col("__p")) & F.col("__ip").between(F.col("__lo"), F.col("__hi"))
    df = df.join(side, on, "left").drop("__ip", "__lo", "__hi", "__p")
    return _named(frame.with_df(df), ranges.values, [f"__v{i}" for i in range(len(ranges.values))], prefix)


def _call(frame: Frame, function: Function, names: tuple[str, ...], prefix: str) -> Frame:
    suffixes, run = function.suffixes, function.run

    @F.pandas_udf(T.StructType([T.StructField(s, T.StringType()) for s in suffixes]))
    def call(*columns: pd.Series) -> pd.DataFrame:
        out = run(*columns)
        return out[list(suffixes)].astype(object).where(out[list(suffixes)].notna(), None)

    df = frame.df.withColumn("__call", call(*[frame.value(n).text() for n in names]))
    for i, s in enumerate(suffixes):
        df = df.withColumn(f"__v{i}", F.col(f"__call.{s}"))
    return _named(frame.with_df(df.drop("__call")), suffixes, [f"__v{i}" for i in range(len(suffixes))], prefix)


def _named(frame: Frame, suffixes: tuple[str, ...], columns: list[str], prefix: str) -> Frame:
    """Hits become fields prefix_suffix; misses leave what the row had."""
    from timberline.operators.transforms import assign, fresh

    for s, c in zip(suffixes, columns):
        at = fresh(frame, s)
        frame = frame.with_df(frame.df.withColumnRenamed(c, at))
        frame = assign(frame, f"{prefix}_{s}", frame.column(at))
    return frame


def lookup(frame: Frame, op: A.Lookup, registry: dict[str, Lookup]) -> Frame:
    """An unknown table changes nothing. One-parameter tables run for each field in turn."""
    found = registry.get(op.table)
    if found is None:
        from timberline.sources.lookups import built_in

        found = built_in().get(op.table)
    if found is None:
        return frame
    if isinstance(found, Function) and found.parameters > 1:
        return _call(frame, found, op.fields, op.table) if len(op.fields) == found.parameters else frame
    several = isinstance(found, Table) and len(found.keys) > 1
    if several:
        if len(op.fields) != len(found.keys):
            return frame
        return _join_table(frame, found, op.fields, op.table)
    for name in op.fields:
        if isinstance(found, Table):
            frame = _join_table(frame, found, (name,), name)
        elif isinstance(found, Ranges):
            frame = _join_ranges(frame, found, name, name)
        else:
            frame = _call(frame, found, (name,), name)
    return frame
