"""Named queries over sources, sinks, streams, lookups and the front end, with the SQL that mirrors them.

Each writes the driver's tables in the form that a source reads, or reads back what a sink wrote.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import api
from timberline.catalog import ORACLES, QUERIES, _CHART, add, add_function, events, read
from timberline.functions import digest
from timberline.lang.errors import QueryError
from timberline.lang.highlight import at_cursor, highlight
from timberline.lang.parser import parse_filter
from timberline.operators import retention
from timberline.plans.frame import start
from timberline.plans.predicates import tokens
from timberline.sources import generators, lookups, readers, sinks
from timberline.sources.records import Records, from_parquet, promote
from timberline.streaming import follow as live


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="timberline-")
    return f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"


class Sql(str):
    """A piece of Spark SQL, as against a plain text."""


def said(*parts: str) -> Sql:
    """SQL that strings texts and expressions together (no session is needed to say it)."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return Sql("concat(" + ", ".join(p if isinstance(p, Sql) else quoted(p) for p in parts) + ")")


def text(name: str) -> Sql:
    return Sql(f"CAST({name} AS STRING)")


def messages(line: Sql):
    """A source of events whose raw message is made of the event's columns."""

    def make(spark: SparkSession, sf_dir: str) -> Records:
        df = read(spark, sf_dir, "events").select("ts", "event_id", F.expr(line).alias("line"))
        return promote(df, "ts", "event_id", "line", "auto", drop=("event_id",))

    return make


# --- extraction ------------------------------------------------------------------------

add("e2_key_values", "| stats count as n, sum(user.id) as s by kind, q", "SELECT event_type AS kind, 'a b' AS q, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS s FROM events GROUP BY 1",
    messages(said("<x> kind=", text("event_type"), ", (user.id=", text("user_id"), ") q='A b' bad=a=b")))
add("e3_logfmt", "flag=true | stats count as n, max(user) as m by kind, msg", "SELECT event_type AS kind, 'it \"said\" x' AS msg, count(*) AS n, CAST(max(user_id) AS DOUBLE) AS m FROM events GROUP BY 1",
    messages(said("ts=1 kind=", text("event_type"), ' msg="it \\"said\\" x" flag user=', text("user_id"))))
add("e4_access_log", "method=get | stats count as n, count(body_bytes) as b, count(referer) as r by status, user_agent",
    "SELECT CAST(200 + 100 * (user_id % 4) AS VARCHAR) AS status, 'curl/8' AS user_agent, count(*) AS n, count(*) FILTER (WHERE event_id % 3 > 0) AS b, 0::BIGINT AS r FROM events GROUP BY 1",
    messages(said('10.0.0.1 - bob [01/Jan/2025:00:00:00 +0000] "GET /i HTTP/1.1" ', text("200 + 100 * (user_id % 4)"), " ", text("event_id % 3"), ' "-" "curl/8"')))
add("e6_json_paths", "a=* a.b=error | stats count as n", "SELECT count(*) AS n FROM events WHERE event_type = 'error'", messages(said('{"a": {"b": ["X", "', text("event_type"), '"]}}')))
add("e7_later_pairs_win", '| stats count as n by k, level', "SELECT event_type AS k, 'info' AS level, count(*) AS n FROM events GROUP BY 1", messages(said("k=first level=info k=", text("event_type"))))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


add_function("e1_tokens", token_counts, r"""
SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda t: lower(left(t, 16))))) AS token FROM documents)
WHERE length(token) >= 2 AND NOT regexp_full_match(token, '0x[0-9a-f]+|0o[0-7]+|0b[01]+|[0-9a-f-]*[0-9a-f][0-9a-f-]*') GROUP BY token""")


def chunked(spark: SparkSession, sf_dir: str) -> Records:
    records = events(spark, sf_dir)
    return Records(records.df.withColumn("chunk_id", F.date_format("ingest_ts", "yyyy-MM-dd")), records.promoted, "none")


add("f15_chunk", "chunk=2024-01-05 | stats count as n", "SELECT count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'", chunked)

# --- charts, order, exactness --------------------------------------------------------------


def chart(name: str, query: str, sql: str) -> None:
    add_function(name, lambda s, d: s.createDataFrame([(api.search(events(s, d), query).chart(),)], "chart string"), sql)


chart("p14_linechart", "| stats count as n by bin(1h) | linechart", "SELECT CASE WHEN min(ts) < date_trunc('hour', max(ts)) THEN 'linechart' ELSE 'table' END AS chart FROM events")
chart("p15_barchart", "| stats count as n by event_type | barchart", "SELECT CASE WHEN count(DISTINCT event_type) >= 2 THEN 'barchart' ELSE 'table' END AS chart FROM events")
chart("p16_donut", "| stats count as n by event_type, user_id | donut", "SELECT 'table' AS chart")
chart("p17_heatmap", "| stats count as n by event_type, user_id | heatmap", "SELECT CASE WHEN count(DISTINCT (event_type, user_id)) >= 4 THEN 'heatmap' ELSE 'table' END AS chart FROM events")
chart("p18_scatter", "| stats avg(value) as a, max(value) as m by user_id | scatter a m", "SELECT CASE WHEN count(DISTINCT user_id) >= 2 THEN 'scatter' ELSE 'table' END AS chart FROM events")
chart("p19_map", "| stats count as n by event_type | map choropleth event_type", "SELECT 'table' AS chart")


def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.search(events(spark, sf_dir), "| stats count as n by event_type").dataframe(sort=True).collect()  # a row an event type
    return spark.createDataFrame([(i, r["event_type"], r["n"]) for i, r in enumerate(rows)], "place long, event_type string, n long")


add_function("a18_output_order", in_order, "SELECT row_number() OVER (ORDER BY event_type) - 1 AS place, event_type, count(*) AS n FROM events GROUP BY event_type")
add_function("a19_no_group_cap", lambda s, d: api.search(events(s, d), "| stats count as n by event_id").dataframe().agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total")), "SELECT count(DISTINCT event_id) AS groups, CAST(count(*) AS BIGINT) AS total FROM events")
add("a9_descending", "| sort -event_type, -value | stats first(value) as f, last(event_id) as l, values(event_type) as v", """
SELECT (SELECT value FROM events ORDER BY event_type DESC, value DESC, ts, event_id LIMIT 1) AS f, (SELECT event_id FROM events ORDER BY event_type, value, ts DESC, event_id DESC LIMIT 1) AS l,
(SELECT string_agg(event_type, ', ' ORDER BY event_type DESC) FROM (SELECT DISTINCT event_type FROM events)) AS v""")  # fmt: skip


def sourced(spark: SparkSession, sf_dir: str) -> Records:
    df = read(spark, sf_dir, "events").drop("props").withColumn("src", F.expr("ts + make_dt_interval(CAST(event_id % 7 AS INT))"))
    return promote(df, "ts", "event_id", source_ts="src")


_SHIFTED = "(SELECT ts + INTERVAL 1 DAY * (event_id % 7) AS ts, event_type, value FROM events)"
add("h3_timechart_source_time", "order=source_ts | timechart 12", _CHART.format(n=12, by="''", out="", where="").replace("FROM events", f"FROM {_SHIFTED} AS e"), sourced)
add("h6_exact_filtered", "value>50 | timechart 500", _CHART.format(n=500, by="''", out="", where="").replace("FROM events", "FROM (SELECT * FROM events WHERE value > 50) AS e"))
add("h7_no_scan_cap", "| timechart 1", _CHART.format(n=1, by="''", out="", where=""))
add("h8_exact_everywhere", "NOT event_type=error value<80 | timechart 37 by event_type", _CHART.format(n=37, by="event_type", out="coalesce(g, '') AS event_type,", where="").replace("FROM events", "FROM (SELECT * FROM events WHERE event_type <> 'error' AND value < 80) AS e"))
add("h11_exact_tokens", "done | timechart 9", _CHART.format(n=9, by="''", out="", where="").replace("FROM events", "FROM (SELECT * FROM events WHERE event_type = 'click') AS e"), messages(Sql("if(event_type = 'click', 'all done', 'undone')")))

# --- ingest --------------------------------------------------------------------------------

RECORD = ["vault_id", "n"]


def digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(said("<", text("user_id % 8 + 8"), ">Jan  2 03:04:05 host level=debug at ", Sql("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"), "Z"))
    df = read(spark, sf_dir, "events").select(raw.alias("raw"), F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("level"), F.lit("given"))).alias("attrs"), F.lit(None).cast("timestamp").alias("source_ts"))
    out = digest.digest(df, datetime(2024, 6, 1, tzinfo=UTC))
    return out.groupBy(F.element_at("attrs", "level").alias("level"), F.col("source_ts").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))


add_function("g3_digest_order", digested, """
SELECT CASE WHEN event_id % 5 = 0 THEN 'given' WHEN user_id % 8 <= 3 THEN 'error' WHEN user_id % 8 = 4 THEN 'warn' WHEN user_id % 8 <= 6 THEN 'info' ELSE 'debug' END AS level,
TIMESTAMP '2024-01-02 03:04:05' AS at, count(*) AS n FROM events GROUP BY 1""")

_FILTERS = ("level=error", "NOT a=1 OR b!=2", "oops", "/x/", "oo*", "len(a) > 2", "a=* (b=c oops)")


def attribute_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fits(f: str) -> bool:
        try:
            sinks.attributes_only(parse_filter(f))
        except QueryError:
            return False
        return True

    return spark.createDataFrame([(f, fits(f)) for f in _FILTERS], "filter string, fits boolean")


add_function("g5_attribute_filters", attribute_only, "SELECT * FROM (VALUES ('level=error', true), ('NOT a=1 OR b!=2', true), ('oops', false), ('/x/', false), ('oo*', false), ('len(a) > 2', false), ('a=* (b=c oops)', false)) t(filter, fits)")


def stored(records: Records) -> DataFrame:
    """Records with attributes as a map, as sources give them."""
    frame = start(records, False)
    entries = F.array(*[F.struct(F.lit(n).alias("key"), frame.column(c).text().alias("value")) for n, c in records.promoted.items()])
    raw = [F.col("raw")] if frame.has("raw") else [F.lit("").alias("raw")]
    return frame.df.select(*[c for c in frame.df.columns if c in ("source_ts", "ingest_ts", "write_ts", "ingest_seq")], F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("attrs"), *raw)


def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch routed into vaults, and again as after a failure."""
    batch, at = stored(events(spark, sf_dir)), folder(spark)
    routes = [sinks.Route("errors", "event_type=error"), sinks.Route("clicks", "event_type=click"), sinks.Route("both", "event_type=error OR event_type=click")]
    for _ in range(2):
        counts = sinks.vault_batch(batch, routes, at, "b-0")
    found = spark.read.parquet(at).groupBy("vault_id").agg(F.count(F.lit(1)).alias("n"))
    lost = spark.createDataFrame([("", counts["unrouted"])], "vault_id string, n long")
    return found.select("vault_id", "n").unionByName(lost)


add_function("g6_fan_out", fanned_out, """
SELECT 'errors' AS vault_id, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'clicks', count(*) FROM events WHERE event_type = 'click'
UNION ALL SELECT 'both', count(*) FROM events WHERE event_type IN ('error', 'click') UNION ALL SELECT '', count(*) FROM events WHERE event_type NOT IN ('error', 'click')""")
add_function("g7_distribution", lambda s, d: sinks.route(stored(events(s, d)), [
    sinks.Route("a", "*", ("b", "c"), "round-robin"), sinks.Route("p", "event_type=error", ("q",), "failover", frozenset({"p"})), sinks.Route("x", "event_type=click", ("y",)),
]).groupBy("vault_id").agg(F.count(F.lit(1)).alias("n")), """
SELECT ['a', 'b', 'c'][1 + event_id % 3] AS vault_id, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'q', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT v, count(*) FROM events, (VALUES ('x'), ('y')) t(v) WHERE event_type = 'click' GROUP BY 1""")  # fmt: skip

# --- sinks ---------------------------------------------------------------------------------


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    n = api.export(events(spark, sf_dir), "event_type=error | export kept", at)
    back = spark.read.parquet(at)
    return back.groupBy("vault_id", F.element_at("attrs", "user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("written", F.lit(n).cast("long"))


add_function("k1_export", exported, "SELECT 'kept' AS vault_id, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS written FROM events WHERE event_type = 'error' GROUP BY user_id")
QUERIES["p20_export_pipe"], ORACLES["p20_export_pipe"] = QUERIES["k1_export"], ORACLES["k1_export"]


def vault_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole vault written out and read as a source again."""
    at = folder(spark)
    sinks.vault(stored(events(spark, sf_dir, raw=True)).withColumn("vault_id", F.lit("main")), at)
    return api.search(from_parquet(spark, at), "vault_id=main | stats count as n, sum(value) as s by event_type").dataframe().select("event_type", "n", F.round("s", 4).alias("s"))


_BY_TYPE = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1"
for _name in ("k2_vault_export", "s14_chunk_scan", "s16_stored_parquet"):
    add_function(_name, vault_copy, _BY_TYPE)


def json_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON sink writes, parsed again."""
    written = sinks.lines(sinks.json_rows(start(events(spark, sf_dir, raw=True), False).df), "json")
    row = F.from_json("line", "ingest_ts timestamp, write_ts timestamp, raw string")
    return written.select(row.alias("r")).select(F.col("r.ingest_ts").cast("timestamp_ntz").alias("at"), F.col("r.raw").alias("raw"))


add_function("k3_json_lines", json_tier, "SELECT date_trunc('millisecond', ts) AS at, props AS raw FROM events")
add_function("k4_csv_lines", lambda s, d: sinks.lines(read(s, d, "events"), "csv", ["event_id", "event_type", "user_id"]), "SELECT event_id || ',' || event_type || ',' || user_id AS line FROM events")
add_function("k4_raw_lines", lambda s, d: sinks.lines(start(events(s, d, raw=True), False).df, "raw"), "SELECT props AS line FROM events")

# --- sources -------------------------------------------------------------------------------


def written(spark: SparkSession, sf_dir: str, line: Sql) -> str:
    """A folder of text files, a line an event."""
    at = folder(spark)
    read(spark, sf_dir, "events").select(F.expr(line).alias("value")).write.text(at)
    return at


def counted(df: DataFrame, *names: str) -> DataFrame:
    """Number of records by attributes."""
    return df.groupBy(*[F.element_at("attrs", n).alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))


_PRI = text("user_id % 24 * 8 + event_id % 8")
add_function("s1_syslog_old", lambda s, d: counted(readers.syslog_lines(s, written(s, d, said("<", _PRI, ">Jan  2 03:04:05 web-", text("event_type"), " app[", text("event_id % 3"), "]: hello"))), "facility", "severity", "hostname", "app_name", "proc_id"),
    "SELECT CAST(user_id % 24 AS VARCHAR) AS facility, CAST(event_id % 8 AS VARCHAR) AS severity, 'web-' || event_type AS hostname, 'app' AS app_name, CAST(event_id % 3 AS VARCHAR) AS proc_id, count(*) AS n FROM events GROUP BY ALL")
add_function("s1_syslog_new", lambda s, d: counted(readers.syslog_lines(s, written(s, d, said("<", _PRI, ">1 2024-01-02T03:04:05Z web ", text("event_type"), " - ID7 - hello"))), "severity_name", "app_name", "proc_id", "msg_id", "version"),
    "SELECT ['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'][1 + event_id % 8] AS severity_name, event_type AS app_name, NULL::VARCHAR AS proc_id, 'ID7' AS msg_id, '1' AS version, count(*) AS n FROM events GROUP BY ALL")
_NS = said(text("unix_micros(CAST(date_trunc('second', ts) AS TIMESTAMP))"), "000")
add_function("s2_push_json", lambda s, d: readers.push_json(s, written(s, d, said('{"streams": [{"stream": {"app": "', text("event_type"), '", "x": "1"}, "values": [["', _NS, '", "line ', text("event_id"), '", {"x": "2", "y": "3"}]]}]}')), multi_line=False)
    .groupBy(F.element_at("attrs", "app").alias("app"), F.element_at("attrs", "x").alias("x"), F.element_at("attrs", "y").alias("y")).agg(F.count_distinct("raw").alias("lines"), F.min("source_ts").cast("timestamp_ntz").alias("at")),
    "SELECT event_type AS app, '2' AS x, '3' AS y, count(*) AS lines, min(date_trunc('second', ts)) AS at FROM events GROUP BY 1")
_OTLP = said('{"resourceLogs": [{"resource": {"attributes": [{"key": "svc", "value": {"stringValue": "s"}}]}, "scopeLogs": [{"scope": {"name": "sc"}, "logRecords": [{"observedTimeUnixNano": "', _NS,
    '", "severityNumber": 9, "severityText": "', text("event_type"), '", "body": {"kvlistValue": {"values": [{"key": "id", "value": {"intValue": "', text("event_id"), '"}}, {"key": "a", "value": {"boolValue": true}}]}}, "attributes": [{"key": "l", "value": {"arrayValue": {"values": [{"stringValue": "x"}, {"doubleValue": 0.5}]}}}, {"key": "svc", "value": {"stringValue": "mine"}}, {"key": "u", "value": {"intValue": ', text("user_id"), "}}]}]}]}]}")
add_function("s4_otlp_json", lambda s, d: readers.otlp_json(s, written(s, d, _OTLP), multi_line=False).select(F.element_at("attrs", "severity").alias("severity"), F.element_at("attrs", "svc").alias("svc"), F.element_at("attrs", "u").alias("u"), F.element_at("attrs", "l").alias("l"), "raw", F.col("source_ts").cast("timestamp_ntz").alias("at")),
    """SELECT event_type AS severity, 'mine' AS svc, CAST(user_id AS VARCHAR) AS u, '["x","0.5"]' AS l, '{"a":"true","id":"' || event_id || '"}' AS raw, date_trunc('second', ts) AS at FROM events""")  # fmt: skip


def from_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the form of Spark's Kafka source."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").cast("binary").alias("value"), F.lit("t").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    return readers.from_kafka(rows).groupBy("raw", F.element_at("attrs", "kafka_topic").alias("topic"), F.element_at("attrs", "kafka_partition").alias("part")).agg(F.count(F.lit(1)).alias("n"))


add_function("s6_kafka_rows", from_topic, "SELECT event_type AS raw, 't' AS topic, CAST(event_id % 3 AS VARCHAR) AS part, count(*) AS n FROM events GROUP BY ALL")


def frames(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    """Nations' names as protocol frames in a capture file, decoded (25 rows, so they are framed here)."""
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").select("n_name").collect()]
    if protocol == "relp":
        content, decode = b"".join(b"%d syslog %d %s\n" % (i, len(n), n.encode()) for i, n in enumerate(names, 1)), readers.decode_relp
    elif protocol == "mqtt":
        body = [len(b"t/x").to_bytes(2, "big") + b"t/x" + n.encode() for n in names]
        content, decode = b"".join(bytes([0x30, len(b)]) + b for b in body), readers.decode_mqtt
    else:
        word = lambda t: bytes([0xA0 | len(t)]) + t.encode() if len(t) < 32 else b"\xd9" + bytes([len(t)]) + t.encode()
        content, decode = b"".join(b"\x93" + word("app.x") + b"\x01\x82" + word("message") + word(n) + word("k") + b"\x07" for n in names), readers.decode_fluent
    rows = spark.createDataFrame([(bytearray(content),)], "content binary")
    return readers.decoded(rows, decode, protocol)


add_function("s3_relp_frames", lambda s, d: frames(s, d, "relp").select("raw", F.element_at("attrs", "relp_txnr").alias("number")), "SELECT n_name AS raw, CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS number FROM nation")
add_function("s5_fluent_frames", lambda s, d: frames(s, d, "fluent").select("raw", F.element_at("attrs", "tag").alias("tag"), F.element_at("attrs", "k").alias("k")), "SELECT n_name AS raw, 'app.x' AS tag, '7' AS k FROM nation")
add_function("s7_mqtt_frames", lambda s, d: frames(s, d, "mqtt").select("raw", F.element_at("attrs", "mqtt_topic").alias("topic")), "SELECT n_name AS raw, 't/x' AS topic FROM nation")


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files tailed as a stream."""
    source = readers.text_lines(spark, written(spark, sf_dir, said(text("event_type"), " ", text("event_id"))), stream=True)
    return run_stream(live.follow(Records(source, extract="none"), "*"), folder(spark)).select("raw")


def run_stream(df: DataFrame, at: str) -> DataFrame:
    """What a stream gives of all there is now."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


add_function("s8_tail", tailed, "SELECT event_type || ' ' || event_id AS raw FROM events")
add_function("s9_container_logs", lambda s, d: readers.container_json(s, written(s, d, said('{"log": "', text("event_type"), '\\n", "stream": "stdout", "time": "', Sql("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"), '.123456789Z"}')), "web", "img:1")
    .select("raw", F.element_at("attrs", "stream").alias("stream"), F.element_at("attrs", "container_name").alias("name"), F.element_at("attrs", "image").alias("image"), F.col("source_ts").cast("timestamp_ntz").alias("at")),
    "SELECT event_type AS raw, 'stdout' AS stream, 'web' AS name, 'img:1' AS image, date_trunc('second', ts) + INTERVAL 123456 MICROSECOND AS at FROM events")
add_function("s10_own_log", lambda s, d: counted(readers.event_log(s, written(s, d, said('{"Event": "Spark', text("event_type"), '", "Job ID": ', text("event_id % 4"), ', "Job Result": {"Result": "', Sql("if(event_type = 'error', 'JobFailed', 'JobSucceeded')"), '"}}'))), "event", "level", "job_id"),
    "SELECT 'Spark' || event_type AS event, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, CAST(event_id % 4 AS VARCHAR) AS job_id, count(*) AS n FROM events GROUP BY ALL")
add_function("s11_vault_metrics", lambda s, d: generators.vault_metrics(start(events(s, d, raw=True), False).df).select("raw", F.element_at("attrs", "vault_id").alias("vault")), "SELECT 'record_count=' || count(*) || ' data_bytes=' || sum(strlen(props)) AS raw, 'main' AS vault FROM events")
add_function("s12_chatter", lambda s, d: generators.chatter(s, 5000, {"access": 1}).where(F.col("raw").rlike(r"^10\.0\.0\.\d+ - - \[.*\] \"(GET|POST|PUT|DELETE) \S+ HTTP/1.1\" \d{3} \d+ \"-\" \"curl/8.0\"$")).agg(F.count(F.lit(1)).alias("n")), "SELECT 5000::BIGINT AS n")
add_function("s13_sequence", lambda s, d: generators.sequence(s, 3000).select(F.get_json_object("raw", "$.seq").cast("long").alias("seq"), F.element_at("attrs", "seq").alias("attr"), F.col("ingest_ts").cast("timestamp_ntz").alias("at")),
    "SELECT i AS seq, CAST(i AS VARCHAR) AS attr, TIMESTAMP '2025-01-01' + INTERVAL 1 SECOND * i AS at FROM range(3000) t(i)")


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk load: identities stay, the write time is the import's."""
    now = datetime(2030, 1, 1, tzinfo=UTC)
    out = sinks.imported(stored(events(spark, sf_dir)).withColumn("vault_id", F.lit("old")), "new", now)
    return out.select("vault_id", "ingest_seq", F.col("ingest_ts").cast("timestamp_ntz").alias("ingest_ts"), F.col("write_ts").cast("timestamp_ntz").alias("write_ts"))


add_function("s15_import", imported, "SELECT 'new' AS vault_id, event_id AS ingest_seq, ts AS ingest_ts, TIMESTAMP '2030-01-01' AS write_ts FROM events")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault as JSON lines under a URI, read as a source."""
    at = folder(spark)
    at = at if "://" in at else f"file://{at}"
    sinks.json_lines(stored(events(spark, sf_dir)), at)
    return api.search(Records(readers.json_lines(spark, at), extract="none"), "| stats count as n, sum(value) as s by event_type").dataframe().select("event_type", "n", F.round("s", 4).alias("s"))


add_function("s17_files_by_uri", json_round_trip, _BY_TYPE)

# --- lookups -------------------------------------------------------------------------------


def joined(name: str, query: str, sql: str, make, source=events) -> None:
    add(name, query, sql, source, lookups=make)


def csv_nations(spark: SparkSession, sf_dir: str) -> dict:
    """nation as CSV, each key twice: the first row counts."""
    at, nation = folder(spark), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    both = nation.unionByName(nation.withColumn("n_name", F.lit("later"))).coalesce(1)
    both.write.option("header", True).option("sep", ";").csv(at)
    return {"t": lookups.csv_table(spark, at, "key", delimiter=";")}


def json_nations(spark: SparkSession, sf_dir: str) -> dict:
    at = folder(spark)
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.struct("n_name", "n_regionkey").alias("about")).coalesce(1).write.json(at)
    return {"t": lookups.json_table(spark, at, "key", multi_line=False, columns={"key": "key", "name": "about.n_name", "region": "array(about.n_regionkey)"})}


_NATION = "(SELECT event_id, user_id % 30 AS k FROM events) LEFT JOIN nation ON k = n_nationkey"
joined("j6_csv", "| eval k = user_id % 30 | lookup t k | stats count as n by k_n_name", f"SELECT coalesce(n_name, '') AS k_n_name, count(*) AS n FROM {_NATION} GROUP BY 1", csv_nations)
joined("j7_json", "| eval k = user_id % 30 | lookup t k | stats count as n by k_name, k_region", f"SELECT coalesce(n_name, '') AS k_name, coalesce('[' || n_regionkey || ']', '') AS k_region, count(*) AS n FROM {_NATION} GROUP BY 1, 2", json_nations)
joined("j9_static", "| lookup t event_type | stats count as n by event_type_team", "SELECT CASE event_type WHEN 'click' THEN 'web' WHEN 'error' THEN 'ops' ELSE '' END AS event_type_team, count(*) AS n FROM events GROUP BY 1",
    lambda s, d: {"t": lookups.static_table(s, [{"event_type": "click", "team": "web"}, {"event_type": "error", "team": "ops"}, {"event_type": "click", "team": "no"}], ("event_type",))})
joined("j8_http", "| lookup t event_type user_id | stats count as n by t_who", "SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type || '/' || user_id END AS t_who, count(*) AS n FROM events GROUP BY 1",
    lambda s, d: {"t": lookups.http(lambda url: "oops" if "/error/" in url else json.dumps({"data": [{"who": url.removeprefix("http://x.test/")}]}), "http://x.test/{kind}/{user}", ("who",), paths=("$.data[0]",))})
joined("j2_reverse_dns", "| eval ip = concat(\"10.0.0.\", user_id % 9) | lookup names ip | stats count as n by ip_hostname", "SELECT CASE WHEN user_id % 9 < 5 THEN 'h' || user_id % 9 || '.test' ELSE '' END AS ip_hostname, count(*) AS n FROM events GROUP BY 1",
    lambda s, d: {"names": lookups.reverse_dns(lambda ip: f"h{ip[-1]}.test" if ip[-1] < "5" else None)})
_AGENTS = ("Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) Version/17.0 Mobile Safari/604.1", "Googlebot/2.1")


def agents(spark: SparkSession, sf_dir: str) -> Records:
    df = read(spark, sf_dir, "events").drop("props")
    return promote(df.withColumn("ua", F.element_at(F.array(*map(F.lit, _AGENTS)), (F.col("event_id") % 3 + 1).cast("int"))), "ts", "event_id")


joined("j3_user_agent", "| lookup useragent ua | stats count as n by ua_browser, ua_os, ua_device_type",
    "SELECT ['Chrome', 'Safari', ''][1 + event_id % 3] AS ua_browser, ['Windows', 'iOS', ''][1 + event_id % 3] AS ua_os, ['desktop', 'mobile', 'bot'][1 + event_id % 3] AS ua_device_type, count(*) AS n FROM events GROUP BY ALL", None, agents)
QUERIES["j10_built_in"], ORACLES["j10_built_in"] = QUERIES["j3_user_agent"], ORACLES["j3_user_agent"]

# --- pages, streams, front end -----------------------------------------------------------------


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a search: the first by itself, and those behind its token at once."""
    rows, token = api.page(events(spark, sf_dir), _SEARCH, 50)
    first = spark.createDataFrame([(i, r["a_event_id"]) for i, r in enumerate(rows)], "place long, event_id long")
    if token is None:
        return first
    return first.unionByName(api.pages(events(spark, sf_dir), _SEARCH, 50, token).select((F.col("row_no") + len(rows)).alias("place"), "event_id"))


_SEARCH = "event_type=error value>100"
add_function("m4_pages", paged, "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS place, event_id FROM events WHERE event_type = 'error' AND value > 100")


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, rows = folder(spark), stored(events(spark, sf_dir))
    rows.write.parquet(f"{at}/in")
    source = Records(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), extract="none")
    return run_stream(live.follow(source, "event_type=click | eval big = value * 2 | where big>100"), at).select(F.element_at("attrs", "event_id").cast("long").alias("event_id"))


add_function("m5_follow", followed, "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explain says of a scan: the time bound and the filter are pushed, two columns are read."""
    found = api.scans(api.search(events(spark, sf_dir), "start=2024-01-03T00:00:00Z event_type=click | stats sum(value) as s").frame.df)
    facts = [(len(found), "GreaterThanOrEqual(ts," in x["pushed_filters"], x["columns"].count(":"), x["files"] <= x["of"]) for x in found]
    return spark.createDataFrame(facts, "scans int, bound_pushed boolean, columns int, files_known boolean")


add_function("m10_explain", planned, "SELECT 1 AS scans, true AS bound_pushed, 3 AS columns, true AS files_known")
_TEXTS = ("level=error | stats count by x", "a=", "| head", "x | where (", "last=5m ok")


def front_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for t in _TEXTS:
        valid, _, at = api.validate(t)
        spans, pipes = highlight(t)
        rows.append((t, valid, at if not valid else -1, "".join(x for x, _ in spans) == t, pipes, ",".join(at_cursor(t + " | st", len(t) + 5, ["f"])[1])))
    return spark.createDataFrame(rows, "text string, valid boolean, place int, whole boolean, pipes boolean, fit string")


add_function("m11_front_end", front_end, """SELECT * FROM (VALUES ('level=error | stats count by x', true, -1, true, true, 'stats'), ('a=', false, 2, true, false, 'stats'), ('| head', false, 6, true, true, 'stats'),
('x | where (', false, 11, true, true, 'stats'), ('last=5m ok', true, -1, true, false, 'stats')) t(text, valid, place, whole, pipes, fit)""")
add_function("m12_analysis", lambda s, d: api.analyze(chunked(s, d)).select("chunk_id", "kind", "records", "covered", "entries", "keys", "pairs"), """
SELECT strftime(ts, '%Y-%m-%d') AS chunk_id, 'attr' AS kind, count(*) AS records, count(*) AS covered, count(*) * 4 AS entries, 4::BIGINT AS keys,
count(DISTINCT event_id) + count(DISTINCT user_id) + count(DISTINCT event_type) + count(DISTINCT value) AS pairs FROM events GROUP BY 1""")
_AT = datetime(2024, 1, 5, 10, 30, tzinfo=UTC)
_RULES = (
    ("bytes", retention.Rotation(most_bytes=10), (10, 1, timedelta(0))), ("records", retention.Rotation(most_records=5), (1, 4, timedelta(0))), ("age", retention.Rotation(most_age=timedelta(hours=1)), (0, 1, timedelta(hours=2))),
    ("hard", retention.Rotation(hard_bytes=10), (8, 1, timedelta(0), 3)), ("cron", retention.Rotation(schedule="0 * * * *"), (0, 1, timedelta(0), 0, _AT, _AT + timedelta(minutes=30))),
    ("cron later", retention.Rotation(schedule="0 12 * * 1-5"), (0, 1, timedelta(0), 0, _AT, _AT + timedelta(minutes=30))),
)
add_function("m13_rotation", lambda s, d: s.createDataFrame([(n, r.due(*a)) for n, r, a in _RULES], "rule string, due boolean"), "SELECT * FROM (VALUES ('bytes', true), ('records', false), ('age', true), ('hard', true), ('cron', true), ('cron later', false)) t(rule, due)")


def let_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault tree after its rules: old days ejected by event type, the next oldest moved on, the rest there."""
    at = folder(spark)
    df = stored(events(spark, sf_dir)).withColumn("vault_id", F.lit("main")).withColumn("chunk_id", F.date_format("ingest_ts", "yyyy-MM-dd"))
    df.write.partitionBy("vault_id", "chunk_id").parquet(at)
    now = datetime(2024, 1, 20, tzinfo=UTC)
    rules = [
        retention.Rule(retention.Retention(ttl=timedelta(days=17)), "eject", (sinks.Route("bad", "event_type=error"),), f"{at}-ejected"),
        retention.Rule(retention.Retention(ttl=timedelta(days=15)), "transition", (), f"{at}-next"),
    ]
    retention.retain(at, spark, rules, now)
    count = lambda path, name: spark.read.parquet(path).agg(F.lit(name).alias("place"), F.count(F.lit(1)).alias("n"))
    return count(at, "kept").unionByName(count(f"{at}-ejected", "ejected")).unionByName(count(f"{at}-next", "next"))


add_function("m14_retention_actions", let_go, """
WITH d AS (SELECT *, max(ts) OVER (PARTITION BY CAST(ts AS DATE)) AS e FROM events)
SELECT 'ejected' AS place, count(*) AS n FROM d WHERE e < TIMESTAMP '2024-01-03' AND event_type = 'error' UNION ALL SELECT 'next', count(*) FROM d WHERE e >= TIMESTAMP '2024-01-03' AND e < TIMESTAMP '2024-01-05'
UNION ALL SELECT 'kept', count(*) FROM d WHERE e >= TIMESTAMP '2024-01-05'""")
