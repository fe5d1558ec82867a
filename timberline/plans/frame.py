"""A query's state between operators: a DataFrame, its visible fields and its order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import extract
from timberline.functions.values import Value, missing
from timberline.sources.records import Records

INSTANTS = ("ingest_ts", "write_ts", "source_ts")
FIRST_CLASS = ("ingester_id", "node_id", "ingest_seq", *INSTANTS)


@dataclass(frozen=True)
class Order:
    """One sort column; nulls come first going up."""

    column: str
    descending: bool = False

    def key(self, flip: bool = False) -> Column:
        down = self.descending != flip
        return F.col(f"`{self.column}`").desc_nulls_last() if down else F.col(f"`{self.column}`").asc_nulls_first()


@dataclass(frozen=True)
class Frame:
    """kind is records or table.

    ``fields`` maps visible names to columns of df. In records, names that aren't there are looked
    up in the attribute map and the pairs extracted from raw, unless ``closed`` or hidden.
    """

    df: DataFrame
    kind: str
    fields: dict[str, str]
    order: tuple[Order, ...] = ()
    extract: str = "none"
    closed: bool = False
    hidden: frozenset = frozenset()
    sorted: bool = False
    notes: tuple[str, ...] = field(default=())

    def with_df(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    @property
    def records(self) -> bool:
        return self.kind == "records"

    def has(self, column: str) -> bool:
        return column in self.df.columns

    def is_numeric(self, column: str) -> bool:
        return isinstance(self.df.schema[column].dataType, T.NumericType)

    def column(self, name: str) -> Value:
        """A physical column as a value; instants as RFC 3339 text."""
        kind = self.df.schema[name].dataType
        c = F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return Value(c, True)
        if isinstance(kind, T.BooleanType):
            return Value(F.when(c, "true").when(~c, "false"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return Value(rfc3339(c))
        return Value(c if isinstance(kind, T.StringType) else c.cast("string"))

    def value(self, name: str) -> Value:
        """The single value of a field, by precedence: own fields, metadata, attributes, extracted (later pairs win)."""
        if name in self.fields:
            return self.column(self.fields[name])
        if not self.records or self.closed or name in self.hidden:
            return missing()
        if name == "raw":
            return self.column("raw") if self.has("raw") else missing()
        if name in FIRST_CLASS and self.has(name):
            own = self.column(name)
            return own if name == "ingest_seq" else Value(F.coalesce(own.text(), *self._open(name)))
        found = self._open(name)
        return Value(F.coalesce(*found)) if found else missing()

    def _open(self, name: str) -> list[Column]:
        out = []
        if self.has("attrs"):
            out.append(F.element_at("attrs", F.lit(name)))
        if self.has("pairs"):
            mine = F.filter("pairs", lambda p: (p["k"] == name) & (p["s"] < extract.PATH))
            out.append(F.when(F.size(mine) > 0, F.element_at(mine, -1)["v"]))
        return out


def rfc3339(ts: Column) -> Column:
    """UTC text with as many fractional digits as needed."""
    text = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+\z", ""), r"\.\z", ""), F.lit("Z"))


def start(records: Records, demand: bool = True, order: str = "ingest_ts", reverse: bool = False) -> Frame:
    """The frame of a search; ``demand`` is whether anything may need fields from raw messages."""
    df = records.df
    mode = records.extract if demand and "raw" in df.columns else "none"
    if mode != "none":
        make = extract.flat_json_pairs if mode == "flat_json" else extract.pairs
        df = df.withColumn("pairs", F.coalesce(make(F.col("raw")), F.array().cast(extract.PAIR)))
    keys = [order, *[c for c in ("ingest_ts", "vault_id", "chunk_id", "pos", "ingester_id", "node_id", "ingest_seq") if c in df.columns and c != order]]
    return Frame(df, "records", dict(records.promoted), tuple(Order(c, reverse and c == order) for c in keys), mode)
