"""Rotation and retention over a catalog of chunks (files of records)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Retention:
    """Chunks to let go: older than ttl, beyond a total size or a number of newest ones; any rule suffices."""

    ttl: timedelta | None = None
    most_bytes: int | None = None
    most_chunks: int | None = None


def expired(chunks: DataFrame, policy: Retention, now: datetime) -> DataFrame:
    """Of chunks (vault_id, chunk_id, write_end, bytes), those the policy lets go."""
    newest = Window.partitionBy("vault_id").orderBy(F.desc("write_end"), "chunk_id")
    rules: list[Column] = []
    if policy.ttl is not None:
        rules.append(F.col("write_end") < F.lit(now - policy.ttl).cast(chunks.schema["write_end"].dataType))
    if policy.most_bytes is not None:
        rules.append(F.col("__bytes") > policy.most_bytes)
    if policy.most_chunks is not None:
        rules.append(F.col("__n") > policy.most_chunks)
    gone = F.lit(False)
    for r in rules:
        gone = gone | r
    running = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = chunks.withColumn("__bytes", F.sum("bytes").over(running)).withColumn("__n", F.row_number().over(newest))
    return df.where(gone).drop("__bytes", "__n")


@dataclass(frozen=True)
class Rotation:
    """When to close a chunk: any limit reached, the next record no longer fitting the hard limit, or a time of the schedule passed.

    ``schedule`` is a cron line: minute, hour, day of month, month, day of week (0 or 7 is Sunday).
    """

    most_bytes: int | None = None
    most_records: int | None = None
    most_age: timedelta | None = None
    hard_bytes: int | None = None
    schedule: str | None = None

    def due(self, bytes_: int, records: int, age: timedelta, following: int = 0, opened: datetime | None = None, now: datetime | None = None) -> bool:
        limits = ((self.most_bytes, bytes_), (self.most_records, records), (self.most_age, age))
        if any(limit is not None and value >= limit for limit, value in limits):
            return True
        if self.hard_bytes is not None and records and bytes_ + following > self.hard_bytes:
            return True
        if self.schedule and opened and now:
            return next_time(self.schedule, opened) <= now
        return False


_CRON = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _cron_field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            first, _, last = span.partition("-")
            a = int(first)
            b = int(last) if last else high if step else a
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out |= set(range(a, b + 1, int(step) if step else 1))
    return out


def next_time(schedule: str, after: datetime) -> datetime:
    """The first minute after a time that a cron line names. With both days given, either suffices."""
    fields = schedule.split()
    if len(fields) != 5:
        raise ValueError(f"a cron line has five fields: {schedule!r}")
    minutes, hours, days, months, weekdays = (_cron_field(f, a, b) for f, (a, b) in zip(fields, _CRON))
    weekdays = {d % 7 for d in weekdays}
    either = fields[2] != "*" and fields[4] != "*"
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 8):
        by_month, by_week = at.day in days, (at.isoweekday() % 7) in weekdays
        if at.month in months and (by_month or by_week if either else by_month and by_week):
            for minute in range(at.hour * 60 + at.minute, 24 * 60):
                if minute // 60 in hours and minute % 60 in minutes:
                    return at.replace(hour=minute // 60, minute=minute % 60)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    raise ValueError(f"no time fits {schedule!r}")


@dataclass(frozen=True)
class Rule:
    """What becomes of chunks that a policy lets go: "expire" deletes them, "eject" sends their records through
    routes, "transition" moves them to the next tier's folder."""

    policy: Retention
    action: str = "expire"
    routes: tuple = ()
    tier: str | None = None


def retain(path: str, spark: SparkSession, rules: list[Rule], now: datetime) -> int:
    """Apply rules in turn to a vault tree of Parquet partitioned by vault_id and chunk_id; returns the number of chunks let go.

    Records are written to where they go before their chunk is deleted. Chunks are partitions, so a
    deletion is of a folder; what comes to the driver is a row a chunk let go.
    """
    from timberline.sources import sinks

    gone = 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for rule in rules:
        if rule.action not in ("expire", "eject", "transition"):
            raise ValueError(f"unknown action {rule.action!r}")
        records = spark.read.parquet(path)
        chunks = expired(catalog(records), rule.policy, now).select("vault_id", "chunk_id").collect()
        if not chunks:
            continue
        if rule.action != "expire":
            named = spark.createDataFrame(chunks, records.select("vault_id", "chunk_id").schema)
            leaving = records.join(F.broadcast(named), ["vault_id", "chunk_id"], "left_semi")
            if rule.action == "eject":
                sinks.vault(sinks.route(leaving.drop("chunk_id"), list(rule.routes)), rule.tier or f"{path}-ejected")
            else:
                leaving.write.mode("append").partitionBy("vault_id", "chunk_id").parquet(rule.tier or f"{path}-next")
        for c in chunks:
            files.delete(hadoop(f"{path}/vault_id={c['vault_id']}/chunk_id={c['chunk_id']}"), True)
        gone += len(chunks)
    return gone


def catalog(records: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Per chunk: record count, bytes and the bounds of its times."""
    times = [c for c in ("source_ts", "ingest_ts", "write_ts") if c in records.columns]
    bounds = [f(c).alias(f"{c.removesuffix('_ts')}_{n}") for c in times for f, n in ((F.min, "start"), (F.max, "end"))]
    return records.groupBy("vault_id", chunk).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("raw")).cast("bigint").alias("bytes"), *bounds)
