"""Digesters: level and source time of records, from their messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {
    "error": ("error", "err", "fatal", "critical", "crit", "emerg", "emergency", "alert", "panic"),
    "warn": ("warn", "warning"),
    "info": ("info", "information", "informational", "notice"),
    "debug": ("debug",),
    "trace": ("trace", "verbose"),
}
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: pattern, and how its text becomes what ``formats`` can parse
FORMATS = (
    ("rfc3339", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})"),
    ("apple", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}[+-]\d{4}"),
    ("clf", rf"\d{{2}}/(?:{_MONTHS})/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}"),
    ("slash", r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,9})?"),
    ("ctime", rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:{_MONTHS}) [ \d]\d \d{{2}}:\d{{2}}:\d{{2}} \d{{4}}"),
    ("bsd", rf"(?:{_MONTHS}) [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}"),
)


def normalized_level(word: Column) -> Column:
    low, out = F.lower(word), F.lit(None).cast("string")
    for level, words in LEVELS.items():
        out = F.when(low.isin(*words), level).otherwise(out)
    return out


def level(raw: Column, attrs: Column | None = None) -> Column:
    """Level of a message: syslog priority, else the first level or severity in key=value or JSON form.

    Null if an attribute gives it already, or nothing does.
    """
    priority = F.regexp_extract(raw, r"\A<(\d{1,3})>", 1).try_cast("int")
    severity = F.pmod(priority, F.lit(8))
    by_priority = F.when(priority <= 191, F.when(severity <= 3, "error").when(severity == 4, "warn").when(severity <= 6, "info").otherwise("debug"))
    found = F.regexp_extract(raw, r"""(?i)(?<![A-Za-z0-9_])["']?(?:level|severity)["']?\s*[=:]\s*["']?([A-Za-z]+)""", 1)
    out = F.coalesce(by_priority, normalized_level(found))
    if attrs is not None:
        given = F.coalesce(*[F.element_at(attrs, F.lit(k)) for k in ("level", "severity", "severity_name")])
        out = F.when(given.isNull(), out)
    return out


def _parse(name: str, text: Column, now: datetime) -> Column:
    if name in ("rfc3339", "apple"):
        return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"(\d)([+-]\d{2})(\d{2})\z", "$1$2:$3"), r"(\.\d{6})\d+", "$1"))
    if name == "clf":
        return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    if name == "slash":
        return F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_replace(text, "/", "-"), r"(\.\d{6})\d+", "$1"), F.lit("Z")))
    if name == "ctime":
        return F.try_to_timestamp(F.regexp_replace(F.substring(text, 5, 40), r" +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    # no year: this one, or the last if that is over a day ahead
    at = lambda year: F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(text, r" +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    this = at(now.year)
    return F.when(this > F.lit(now).cast("timestamp") + F.expr("interval 24 hours"), at(now.year - 1)).otherwise(this)


def source_time(raw: Column, now: datetime) -> Column:
    """The timestamp that stands first in a message, of any known format; null if none parses."""
    found = []
    for name, pattern in FORMATS:
        text = F.regexp_extract(raw, f"({pattern})", 1)
        at = F.when(text != "", F.regexp_instr(raw, F.lit(f"({pattern})")))
        found.append(F.struct(at.alias("at"), _parse(name, F.when(text != "", text), now).alias("ts")))
    fit = F.filter(F.array(*found), lambda x: x["at"].isNotNull() & x["ts"].isNotNull())
    return F.array_min(fit)["ts"]


def digest(df: DataFrame, now: datetime) -> DataFrame:
    """Records with attrs.level and source_ts filled in where they were unset; level first, then time."""
    found = level(F.col("raw"), F.col("attrs"))
    attrs = F.when(found.isNotNull(), F.map_concat(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.create_map(F.lit("level"), found))).otherwise(F.col("attrs"))
    df = df.withColumn("attrs", attrs)
    when = source_time(F.col("raw"), now)
    return df.withColumn("source_ts", F.coalesce("source_ts", when) if "source_ts" in df.columns else when)
