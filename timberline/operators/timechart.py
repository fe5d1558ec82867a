"""timechart and the volume histogram: exact counts in equal buckets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from timberline.lang import ast as A
from timberline.operators.stats import TIME, as_time
from timberline.plans.frame import Frame, Order

MOST, USUAL = 500, 50


def buckets_of(n: int) -> int:
    return USUAL if n <= 0 else min(n, MOST)


def timechart(frame: Frame, op: A.Timechart, start: datetime | None = None, end: datetime | None = None, column: str = "ingest_ts") -> Frame:
    """Counts per bucket of [start, end), the last bucket taking the rest of the range.

    A bound that isn't given comes from the data, the end then included. With ``by``: a row per value that
    a bucket has, "" for records without one; empty buckets have one row of 0.
    """
    n = buckets_of(op.buckets)
    us = F.unix_micros(F.col(column).cast("timestamp"))
    by = [] if op.by is None else [F.coalesce(frame.value(op.by).text(), F.lit("")).alias("__by")]
    rows = frame.df.select(us.alias("__us"), *by).where("__us is not null")
    given = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    low = given(start) if start else F.min("__us")
    high = given(end) if end else F.max("__us")
    bounds = rows.agg(low.alias("__lo"), high.alias("__hi")) if not (start and end) else rows.sparkSession.range(1).select(low.alias("__lo"), high.alias("__hi"))
    # widths are whole nanoseconds
    bounds = bounds.where("__lo is not null and __hi is not null").withColumn("__w", F.expr(f"greatest((__hi - __lo) * 1000 div {n}, 1)"))
    inside = "__us >= __lo AND __us <= __hi" if end is None else "__us >= __lo AND __us < __hi"
    placed = rows.join(F.broadcast(bounds), how="cross").where(inside)
    placed = placed.withColumn("__b", F.expr(f"least((__us - __lo) * 1000 div __w, {n - 1})"))
    keys = ["__b", *(["__by"] if by else [])]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select("__lo", "__w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("__b"))
    out = grid.join(counts, "__b", "left")
    columns = [as_time(F.expr("__lo + __b * __w div 1000")).alias(TIME)]
    if by:
        columns.append(F.coalesce("__by", F.lit("")).alias(op.by))
    out = out.select(*columns, F.coalesce("count", F.lit(0)).alias("count"))
    return Frame(out, "table", {c: c for c in out.columns}, tuple(Order(c) for c in out.columns[:-1]))


def volume(frame: Frame, start: datetime | None = None, end: datetime | None = None, buckets: int = USUAL) -> Frame:
    """The histogram beside search results: per bucket and level, records without one as "other"."""
    level = F.coalesce(frame.value("level").text(), F.lit("other"))
    return timechart(frame.with_df(frame.df.withColumn("__level", level), fields={**frame.fields, "level": "__level"}), A.Timechart(buckets, "level"), start, end)
