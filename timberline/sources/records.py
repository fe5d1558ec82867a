"""Records: the DataFrame behind a search, and which of its columns play which part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("vault_id", T.StringType()),
        T.StructField("source_ts", T.TimestampType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("write_ts", T.TimestampType()),
        T.StructField("ingester_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)
STANDARD = (*SCHEMA.names, "chunk_id", "pos")


@dataclass(frozen=True)
class Records:
    """A table of records.

    ``df`` has those standard columns it needs (see SCHEMA, and chunk_id, pos). ``promoted``
    maps attribute names to columns of df kept in their own type: they behave like attributes, and
    filters on them reach the scan. ``extract`` says what fields raw messages yield: "auto" (all
    text forms and JSON), "flat_json" (one-level objects, JVM only) or "none".
    """

    df: DataFrame
    promoted: dict[str, str] = field(default_factory=dict)
    extract: str = "auto"

    def has(self, name: str) -> bool:
        return name in self.df.columns


def promote(df: DataFrame, ts: str, seq: str | None = None, raw: str | None = None, extract: str = "none", vault: str = "main", source_ts: str | None = None, drop: tuple[str, ...] = ()) -> Records:
    """A plain table as records: ts is ingest and write time, every other column a promoted attribute."""
    kinds = dict(df.dtypes)
    # instants keep their type: a cast would keep time bounds from the scan
    instant = lambda c: F.col(c) if kinds[c].startswith("timestamp") else F.col(c).cast("timestamp")
    taken = {ts, raw, *drop}
    plain = {c: f"a_{c}" for c in df.columns if c not in taken}
    columns: list[Column] = [F.lit(vault).alias("vault_id"), instant(ts).alias("ingest_ts"), instant(ts).alias("write_ts")]
    if source_ts:
        columns.append(instant(source_ts).alias("source_ts"))
    columns.append((F.col(seq) if seq else F.lit(0)).cast("bigint").alias("ingest_seq"))
    if raw:
        columns.append(F.col(raw).alias("raw"))
    return Records(df.select(*columns, *[F.col(c).alias(a) for c, a in plain.items()]), plain, extract if raw else "none")


def from_parquet(spark: SparkSession, path: str) -> Records:
    """Stored records: Parquet with the standard columns, partitioned by vault_id or not."""
    return Records(spark.read.parquet(path))


def union(*tables: Records) -> Records:
    """The bag of several vaults' records; duplicates stay."""
    first, df = tables[0], tables[0].df
    for t in tables[1:]:
        df = df.unionByName(t.df, allowMissingColumns=True)
    return Records(df, {k: v for t in reversed(tables) for k, v in t.promoted.items()}, first.extract)
