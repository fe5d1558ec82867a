"""Live tail: row-wise pipelines over record streams, and dedup with bounded state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.api import Result, compile_query
from timberline.lang import ast as A
from timberline.lang.directives import Directives, duration
from timberline.lang.errors import QueryError
from timberline.operators.lookup import Lookup
from timberline.plans import planner
from timberline.plans.frame import start
from timberline.sources.records import Records

ALLOWED = (*planner.ROW_WISE, A.Dedup)
IDENTITY = ("ingester_id", "node_id", "ingest_ts", "ingest_seq")


def follow(records: Records, text: str, lookups: dict[str, Lookup] | None = None) -> DataFrame:
    """A streaming DataFrame of a query's records; operators that need the whole result are errors."""
    query, d = compile_query(text)
    for op in query.pipes:
        if not isinstance(op, ALLOWED):
            raise QueryError(f"{type(op).__name__.lower()} needs the whole result; follow works record by record")
    if not records.df.isStreaming:
        raise QueryError("follow needs a streaming source")
    frame = planner.filtered(planner.bounded(start(records, planner.demand(query)), replace(d, start=None, end=None)), query.filter)
    for op in query.pipes:
        frame = frame.with_df(dedup_stream(frame.df, op.window)) if isinstance(op, A.Dedup) else planner.apply(frame, op, d, lookups or {})
    return Result(frame, query, Directives()).dataframe()


def dedup_stream(df: DataFrame, window: str | None = None) -> DataFrame:
    """dedup over a stream: per identity the write time last kept, forgotten when idle for a while.

    Idleness is measured by a watermark over batch times: no record is late for it, and unlike a
    processing-time timeout it needs no batches without data, so a run over what there is comes to an end.
    """
    try:
        width = int(duration(window).total_seconds() * 1e6) if window else 1_000_000
    except QueryError:
        width = 1_000_000
    width = width if width > 0 else 1_000_000
    idle_ms = max(2 * width // 1000, 60_000)
    schema = df.schema
    keys = {f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in IDENTITY if c in df.columns}

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(frames)).sort_values("write_ts", kind="stable")
        kept = state.get[0] if state.exists else None
        keep = []
        for us in (part["write_ts"].astype("int64") // (1 if str(part["write_ts"].dtype).startswith("datetime64[us") else 1000)).tolist():
            keep.append(kept is None or us - kept > width)
            if keep[-1]:
                kept = us
        state.update((kept,))
        state.setTimeoutTimestamp(int(part["__seen"].max().timestamp() * 1000) + idle_ms)
        out = part[keep]
        yield out[[f.name for f in schema.fields]]

    seen = df.withColumn("__seen", F.current_timestamp()).withWatermark("__seen", "0 seconds")
    grouped = seen.withColumns(keys).groupBy(*keys)
    return grouped.applyInPandasWithState(fold, schema, T.StructType([T.StructField("kept", T.LongType())]), "append", "EventTimeTimeout")


def ingest(df: DataFrame, routes: list, path: str, checkpoint: str, once: bool = True):
    """Write a record stream into the vaults that its routes name; returns the running query.

    A batch that is run again replaces what it wrote before: its files bear the stream's and the batch's names.
    The last batch's numbers of records taken and of records without a vault are in ``ingested``.
    """
    from timberline.sources.sinks import vault_batch

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: ingested.update(vault_batch(batch, routes, path, f"{stream}-{number}")))
    return (writer.trigger(availableNow=True) if once else writer).start()


#: of the last batch in this process: records, and those that went to no vault
ingested: dict[str, int] = {"records": 0, "unrouted": 0}
