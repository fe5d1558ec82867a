"""Sources: files and streams of other systems as records with the standard columns.

File forms are batch or streaming alike (``stream=True`` reads with readStream): text and
syslog lines, push-API JSON, OTLP JSON, container JSON logs, JSON lines. Kafka uses Spark's
connector. Wire protocols without a Spark connector (RELP, MQTT, Fluent Forward) land
through a ``Decoder`` over framed binary files, which is what their brokers and relays write.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.values import render_number
from timberline.sources.records import SCHEMA

FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
PUSH = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
OTLP_DEPTH = 1


def _otlp_type(depth: int = OTLP_DEPTH) -> str:
    """An attribute value; lists nest so deep, what is deeper stays JSON text (each level multiplies the expression's size)."""
    inner = _otlp_type(depth - 1) if depth else ""
    lists = f"arrayValue:struct<values:array<{inner}>>,kvlistValue:struct<values:array<struct<key:string,value:{inner}>>>" if depth else "arrayValue:string,kvlistValue:string"
    return f"struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,{lists}>"


OTLP_VALUE = _otlp_type()
OTLP_ATTRS = f"array<struct<key:string,value:{OTLP_VALUE}>>"
OTLP = f"resourceLogs array<struct<resource:struct<attributes:{OTLP_ATTRS}>,scopeLogs:array<struct<scope:struct<name:string,version:string,attributes:{OTLP_ATTRS}>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{OTLP_VALUE},attributes:{OTLP_ATTRS},traceId:string,spanId:string>>>>>>"


def _read(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def _attrs(**columns: Column) -> Column:
    """A map of the columns that aren't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def sequence_number(stream: bool) -> Column:
    """A number that no other row of the batch has: part of a record's identity. Streams take the high half of a random UUID."""
    if not stream:
        return F.monotonically_increasing_id()
    return F.conv(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 15), 16, 10).cast("bigint")


def standard(df: DataFrame, raw: Column, attrs: Column, source_ts: Column | None = None, ingester: str = "", vault: str = "main", now: Column | None = None) -> DataFrame:
    """The standard columns; ingest and write time are the query's time unless given."""
    now = now if now is not None else F.current_timestamp()
    none = F.lit(None).cast("timestamp")
    values = {
        "vault_id": F.lit(vault), "source_ts": source_ts if source_ts is not None else none, "ingest_ts": now, "write_ts": now, "ingester_id": F.lit(ingester or None),
        "node_id": F.lit(None), "ingest_seq": sequence_number(df.isStreaming), "attrs": attrs, "raw": raw,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def text_lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Tailed files: one record a line, with its file's path; a stream's checkpoint is its bookmark."""
    df = _read(spark, stream).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return standard(df.where("value <> ''"), F.col("value"), _attrs(path=F.col("file")), ingester="tail", **options)


def syslog(line: Column) -> Column:
    """Attributes of an RFC 3164 or RFC 5424 line; an empty map if it is neither."""
    new = r"\A<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+)"
    old = r"\A<(\d{1,3})>(?:\w{3} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?"
    priority = F.regexp_extract(line, r"\A<(\d{1,3})>", 1).try_cast("int")
    priority = F.when(priority <= 191, priority)
    is_new = line.rlike(new)
    given = lambda pattern, i: F.nullif(F.nullif(F.regexp_extract(line, pattern, i), F.lit("")), F.lit("-"))
    either = lambda i, j: F.when(is_new, given(new, i)).otherwise(given(old, j) if j else None)
    names = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), c + 1)
    facility, severity = F.shiftright(priority, 3), F.pmod(priority, F.lit(8))
    return _attrs(
        facility=facility, facility_name=names(FACILITIES, facility), severity=severity, severity_name=names(SEVERITIES, severity),
        hostname=either(4, 2), app_name=either(5, 3), proc_id=either(6, 4), msg_id=F.when(is_new, given(new, 7)), version=F.when(is_new, given(new, 2)),
    )


def syslog_lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    df = _read(spark, stream).text(path)
    return standard(df, F.col("value"), syslog(F.col("value")), ingester="syslog", **options)


def syslog_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP relay, for trials: Spark's socket source keeps no offsets."""
    df = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return standard(df, F.col("value"), syslog(F.col("value")), ingester="syslog")


def _nanos(text: Column) -> Column:
    return F.timestamp_micros(F.floor(text.try_cast("decimal(20,0)") / 1000).cast("bigint"))


def push_json(spark: SparkSession, path: str, stream: bool = False, multi_line: bool = True, **options) -> DataFrame:
    """Push-API bodies, one a file (or a line): streams of labels and [time in ns, line, metadata] entries."""
    df = _read(spark, stream).schema(PUSH).option("multiLine", multi_line).json(path)
    one = df.select(F.explode("streams").alias("s")).select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    meta = F.when(F.size("v") > 2, F.from_json(F.element_at("v", 3), "map<string,string>"))
    empty = F.create_map().cast("map<string,string>")
    keys = F.coalesce("labels", empty)
    attrs = F.map_concat(F.map_filter(keys, lambda k, _: ~F.map_contains_key(F.coalesce(meta, empty), k)), F.coalesce(meta, empty))
    return standard(one, F.element_at("v", 2), attrs, _nanos(F.element_at("v", 1)), "http", **options)


def _otlp_text(v: Column, depth: int = OTLP_DEPTH) -> Column:
    """A value's text: scalars as they are, bytes in hex, lists and key-value lists as JSON of their texts (keys sorted)."""
    plain = [v["stringValue"], v["intValue"], render_number(v["doubleValue"]), v["boolValue"].cast("string"), F.lower(F.hex(F.try_to_binary(v["bytesValue"], F.lit("base64"))))]
    if not depth:
        return F.coalesce(*plain, v["arrayValue"], v["kvlistValue"])
    none = F.lit("")
    items = F.transform(v["arrayValue"]["values"], lambda x: F.coalesce(_otlp_text(x, depth - 1), none))
    entries = F.transform(v["kvlistValue"]["values"], lambda e: F.struct(e["key"].alias("key"), F.coalesce(_otlp_text(e["value"], depth - 1), none).alias("value")))
    both = F.when(v["arrayValue"].isNotNull(), F.coalesce(F.to_json(items), F.lit("[]")))
    listed = F.when(v["kvlistValue"].isNotNull(), F.coalesce(F.to_json(F.map_from_entries(F.array_sort(_last_wins(entries)))), F.lit("{}")))
    return F.coalesce(*plain, both, listed)


def _last_wins(entries: Column) -> Column:
    """Entries (key, value) without those whose key comes again."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))


def _otlp_entries(attributes: Column) -> Column:
    return F.transform(F.coalesce(attributes, F.array().cast(OTLP_ATTRS)), lambda a: F.struct(a["key"].alias("key"), _otlp_text(a["value"]).alias("value")))


def _nanos_text(nanos: Column) -> Column:
    """Nanoseconds since 1970 as RFC 3339 text in UTC, with as many digits as needed; null if 0."""
    n = nanos.try_cast("bigint")
    second = F.to_utc_timestamp(F.timestamp_seconds(F.floor(n / 1_000_000_000)), F.current_timezone())
    digits = F.regexp_replace(F.lpad(F.pmod(n, F.lit(1_000_000_000)).cast("string"), 9, "0"), r"0+\z", "")
    return F.when(n != 0, F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z")))


def otlp_json(spark: SparkSession, path: str, stream: bool = False, multi_line: bool = True, **options) -> DataFrame:
    """OTLP log exports as JSON, one a file (or a line); later attributes win: resource, scope, record. The observed time stands in for a record's own."""
    df = _read(spark, stream).schema(OTLP).option("multiLine", multi_line).json(path)
    one = df.select(F.explode("resourceLogs").alias("r")).select("r", F.explode("r.scopeLogs").alias("s")).select("r", "s", F.explode("s.logRecords").alias("l"))
    given = lambda c: F.nullif(c, F.lit(""))
    own = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in {
        "severity": given(F.col("l.severityText")), "severity_number": F.nullif(F.col("l.severityNumber"), F.lit(0)), "trace_id": given(F.col("l.traceId")), "span_id": given(F.col("l.spanId")),
        "time_unix_nano": _nanos_text(F.col("l.timeUnixNano")), "observed_ts": _nanos_text(F.col("l.observedTimeUnixNano")), "scope_name": given(F.col("s.scope.name")), "ingester_type": F.lit("otlp"),
    }.items()])
    entries = F.filter(F.concat(_otlp_entries(F.col("r.resource.attributes")), _otlp_entries(F.col("s.scope.attributes")), _otlp_entries(F.col("l.attributes")), own), lambda e: e["value"].isNotNull())
    when = F.coalesce(F.nullif(F.col("l.timeUnixNano"), F.lit("0")), F.nullif(F.col("l.observedTimeUnixNano"), F.lit("0")))
    return standard(one, F.coalesce(_otlp_text(F.col("l.body")), F.lit("")), F.map_from_entries(_last_wins(entries)), _nanos(when), "otlp", **options)


def container_json(spark: SparkSession, path: str, name: str = "", image: str = "", stream: bool = False, containers: DataFrame | None = None, **options) -> DataFrame:
    """Container runtime logs: {"log", "stream", "time"} a line.

    A file is named for its container's id; ``containers`` (container_id, name, image), say from the runtime's
    inspect output, names them. Else name and image are those given.
    """
    df = _read(spark, stream).schema("log string, stream string, time string").json(path)
    df = df.select("*", F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{12,64})(?:-json)?\.log", 1), F.lit("")).alias("__id"))
    named, of = F.lit(name or None), F.lit(image or None)
    if containers is not None:
        side = containers.select(F.col("container_id").alias("__cid"), F.col("name").alias("__name"), F.col("image").alias("__image"))
        df = df.join(side, F.col("__id") == F.col("__cid"), "left")
        named, of = F.coalesce("__name", named), F.coalesce("__image", of)
    attrs = _attrs(stream=F.col("stream"), container_id=F.col("__id"), container_name=named, image=of)
    return standard(df, F.regexp_replace("log", r"\n\z", ""), attrs, F.try_to_timestamp(F.regexp_replace("time", r"(\.\d{6})\d+", "$1")), "docker", **options)


def json_lines(spark: SparkSession, path: str, stream: bool = False, vault: str = "main") -> DataFrame:
    """What ``sinks.json_lines`` writes, read again."""
    df = _read(spark, stream).schema("source_ts timestamp, ingest_ts timestamp, write_ts timestamp, attrs map<string,string>, raw string").json(path)
    return df.withColumns({"vault_id": F.lit(vault), "ingester_id": F.lit(None).cast("string"), "node_id": F.lit(None).cast("string"), "ingest_seq": sequence_number(stream)}).select(*SCHEMA.names)


def event_log(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """The engine's own log: Spark's event log, an event a record; level error where it tells of a failure."""
    df = _read(spark, stream).text(path)
    raw = F.col("value")
    given = lambda p: F.get_json_object(raw, p)
    failed = given("$['Job Result'].Result").eqNullSafe("JobFailed") | given("$['Task Info'].Failed").eqNullSafe("true") | given("$['Stage Info']['Failure Reason']").isNotNull()
    attrs = _attrs(level=F.when(failed, "error").otherwise("info"), event=given("$.Event"), job_id=given("$['Job ID']"), stage_id=F.coalesce(given("$['Stage ID']"), given("$['Stage Info']['Stage ID']")))
    millis = F.coalesce(*[given(p) for p in ("$.Timestamp", "$['Submission Time']", "$['Completion Time']", "$['Task Info']['Finish Time']", "$['Task Info']['Launch Time']", "$['Stage Info']['Completion Time']", "$.time")])
    return standard(df.where("value <> ''"), raw, attrs, F.timestamp_millis(millis.try_cast("bigint")), "self", **options)


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """A topic's values, with topic, partition and offset (needs Spark's Kafka package)."""
    reader = _read(spark, stream).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return from_kafka(reader.load())


def from_kafka(df: DataFrame) -> DataFrame:
    attrs = _attrs(kafka_topic=F.col("topic"), kafka_partition=F.col("partition"), kafka_offset=F.col("offset"))
    return standard(df, F.col("value").cast("string"), attrs, F.col("timestamp"), "kafka")


Decoder = Callable[[bytes], Iterator[tuple[dict[str, str], str]]]


def decoded(df: DataFrame, decode: Decoder, ingester: str) -> DataFrame:
    """Records of frames (column content); decode yields (attributes, message) of one row's bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            for content in part["content"]:
                rows = decode(bytes(content))
                while some := list(islice(rows, 10_000)):
                    yield pd.DataFrame({"attrs": [a for a, _ in some], "raw": [r for _, r in some]})

    return standard(df.select("content").mapInPandas(run, "attrs map<string,string>, raw string"), F.col("raw"), F.col("attrs"), ingester=ingester)


def framed(spark: SparkSession, path: str, decode: Decoder, ingester: str, stream: bool = False) -> DataFrame:
    """Binary files of protocol frames; decode yields (attributes, message) of one file."""
    df = _read(spark, stream).format("binaryFile")
    df = df.schema("path string, modificationTime timestamp, length long, content binary").load(path) if stream else df.load(path)
    return decoded(df, decode, ingester)


def decode_relp(content: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """RELP frames: number, command, length, data; syslog commands carry messages."""
    at = 0
    while at < len(content):
        head = content[at:].split(b" ", 3)
        if len(head) < 3:
            return
        number, command = head[0], head[1]
        digits = head[2].split(b"\n")[0]
        size = int(digits)
        start = at + len(number) + len(command) + len(digits) + 3
        if command == b"syslog":
            yield {"relp_txnr": number.decode()}, content[start : start + size].decode("utf-8", "replace")
        at = (start if size else start - 1) + size + 1


def decode_mqtt(content: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """MQTT PUBLISH packets (3.1.1 layout): topic and payload."""
    at = 0
    while at + 2 <= len(content):
        kind, size, shift, i = content[at], 0, 0, at + 1
        while True:
            size |= (content[i] & 127) << shift
            shift += 7
            i += 1
            if not content[i - 1] & 128:
                break
        body = content[i : i + size]
        at = i + size
        if kind >> 4 != 3:
            continue
        n = int.from_bytes(body[:2], "big")
        skip = 2 + n + (2 if kind & 6 else 0)
        yield {"mqtt_topic": body[2 : 2 + n].decode("utf-8", "replace")}, body[skip:].decode("utf-8", "replace")


def decode_fluent(content: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """Fluent Forward messages [tag, time, record] and [tag, [[time, record], ...]] in msgpack."""
    at = 0
    while at < len(content):
        message, at = unpack_msgpack(content, at)
        tag = message[0]
        entries = message[1] if isinstance(message[1], list) else [[message[1], message[2]]]
        if isinstance(message[1], bytes):
            entries, i = [], 0
            while i < len(message[1]):
                entry, i = unpack_msgpack(message[1], i)
                entries.append(entry)
        for _, record in entries:
            fields = {str(k): v if isinstance(v, str) else str(v) for k, v in record.items()}
            raw = fields.pop("message", fields.pop("log", ""))
            yield {"tag": tag, **fields}, raw


def unpack_msgpack(b: bytes, i: int) -> tuple[object, int]:
    """The value at i and where the next begins."""
    import struct

    c = b[i]
    i += 1
    if c < 0x80:
        return c, i
    if c >= 0xE0:
        return c - 256, i
    if c < 0x90 or c in (0xDE, 0xDF):
        n = c & 15 if c < 0x90 else int.from_bytes(b[i : i + (2 if c == 0xDE else 4)], "big")
        i += 0 if c < 0x90 else 2 if c == 0xDE else 4
        out = {}
        for _ in range(n):
            k, i = unpack_msgpack(b, i)
            out[k], i = unpack_msgpack(b, i)
        return out, i
    if c < 0xA0 or c in (0xDC, 0xDD):
        n = c & 15 if c < 0xA0 else int.from_bytes(b[i : i + (2 if c == 0xDC else 4)], "big")
        i += 0 if c < 0xA0 else 2 if c == 0xDC else 4
        items = []
        for _ in range(n):
            x, i = unpack_msgpack(b, i)
            items.append(x)
        return items, i
    if c < 0xC0 or c in (0xD9, 0xDA, 0xDB, 0xC4, 0xC5, 0xC6):
        w = 0 if c < 0xC0 else {0xD9: 1, 0xDA: 2, 0xDB: 4, 0xC4: 1, 0xC5: 2, 0xC6: 4}[c]
        n = c & 31 if c < 0xC0 else int.from_bytes(b[i : i + w], "big")
        raw = b[i + w : i + w + n]
        return (bytes(raw) if 0xC4 <= c <= 0xC6 else raw.decode("utf-8", "replace")), i + w + n
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], i
    if c in (0xD7, 0xC7):  # event time
        i += 1 if c == 0xC7 else 0
        return int.from_bytes(b[i + 1 : i + 5], "big"), i + 9
    fmt = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}[c]
    n = struct.calcsize(fmt)
    return struct.unpack(fmt, b[i : i + n])[0], i + n
