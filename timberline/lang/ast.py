"""Syntax trees of filters, expressions and pipes; immutable, free of Spark."""

from __future__ import annotations

from dataclasses import dataclass

# --- filters ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Glob:
    """A word with * ? or [...]; matches whole words, any case."""

    text: str


@dataclass(frozen=True)
class Token:
    """A word or quoted phrase looked for in the raw message."""

    text: str


@dataclass(frozen=True)
class BareGlob:
    glob: Glob


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class Compare:
    """key op value; key None is any key, value None any value, either may be a Glob."""

    key: str | Glob | None
    op: str
    value: str | Glob | None


@dataclass(frozen=True)
class ExprCompare:
    left: object
    op: str
    value: str


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class MatchAll:
    pass


# --- expressions -----------------------------------------------------------------------


@dataclass(frozen=True)
class Number:
    value: float
    text: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negate:
    term: object


# --- pipes -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Where:
    filter: object


@dataclass(frozen=True)
class Eval:
    assignments: tuple  # of (name, expression)


@dataclass(frozen=True)
class SortKey:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class Sort:
    keys: tuple


@dataclass(frozen=True)
class Head:
    n: int


@dataclass(frozen=True)
class Tail:
    n: int


@dataclass(frozen=True)
class Slice:
    first: int
    last: int


@dataclass(frozen=True)
class Rename:
    pairs: tuple


@dataclass(frozen=True)
class Fields:
    names: tuple
    drop: bool = False


@dataclass(frozen=True)
class Dedup:
    window: str | None = None


@dataclass(frozen=True)
class Lookup:
    table: str
    fields: tuple


@dataclass(frozen=True)
class Raw:
    pass


@dataclass(frozen=True)
class Aggregate:
    func: str
    arg: object | None
    alias: str


@dataclass(frozen=True)
class Bin:
    duration: str
    field: str | None = None


@dataclass(frozen=True)
class Stats:
    aggregates: tuple
    groups: tuple  # of str or Bin


@dataclass(frozen=True)
class Timechart:
    buckets: int
    by: str | None = None


@dataclass(frozen=True)
class Chart:
    """linechart, barchart, donut, heatmap, scatter, choropleth or points, with its columns."""

    kind: str
    columns: tuple = ()


@dataclass(frozen=True)
class Export:
    vault: str


@dataclass(frozen=True)
class Query:
    filter: object | None
    pipes: tuple = ()
