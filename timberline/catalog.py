"""Named queries over the driver's tables, with the SQL that mirrors them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import api
from timberline.functions import digest
from timberline.operators import retention
from timberline.operators.lookup import Function, Ranges, Table
from timberline.plans.frame import start
from timberline.sources import sinks
from timberline.sources.records import Records, promote, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


# --- tables as records -------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, raw: bool = False) -> Records:
    df = read(spark, sf_dir, "events")
    records = promote(df if raw else df.drop("props"), "ts", "event_id", "props" if raw else None, "flat_json")
    return records


def texts(spark: SparkSession, sf_dir: str) -> Records:
    return promote(read(spark, sf_dir, "documents").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "at", "doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> Records:
    return promote(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_orderkey")


def orders(spark: SparkSession, sf_dir: str) -> Records:
    return promote(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


def rows(spark: SparkSession, sf_dir: str, name: str) -> Records:
    return promote(read(spark, sf_dir, name).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "at")


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, text: str, sql: str | None, source: Callable[[SparkSession, str], Records] = events, columns: list[str] | None = None, digits: int | None = None, lookups: Callable | None = None) -> None:
    """Registers a query text over a source; columns are what of the result is compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = api.search(source(spark, sf_dir), text, lookups(spark, sf_dir) if lookups else None).dataframe()
        df = df.select(*columns) if columns else df
        if "ingest_ts" in df.columns:
            df = df.withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp_ntz"))
        return _rounded(df, digits)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def add_function(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


json_events = lambda s, d: events(s, d, raw=True)

# --- filters -----------------------------------------------------------------------------

add("slice_stats_by_user", "event_type=error | stats count as n, avg(value) as v by user_id", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS v FROM events WHERE lower(event_type) = 'error' GROUP BY user_id", digits=6)
add("f1_token", "nicht | stats count as n by lang", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_-])nicht($|[^A-Za-z0-9_-])', 'i') GROUP BY lang", texts)
add("f1_phrase", '"of the" | stats count as n by lang', "SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'of the') GROUP BY lang", texts)
add("f2_equals", "event_type=CLICK | stats count as n by user_id", "SELECT user_id, count(*) AS n FROM events WHERE lower(event_type) = 'click' GROUP BY user_id")
add("f3_not_equals", "event_type!=error | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM events WHERE lower(event_type) <> 'error' GROUP BY event_type")
add("f4_compare", "value>=50 value<80 | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM events WHERE value >= 50 AND value < 80 GROUP BY event_type")
add("f4_compare_json", "k>50 | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 GROUP BY event_type", json_events)
add("f5_exists", "k=* missing!=x OR k=* | stats count as n", "SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL", json_events)
add("f6_any_key", "*=click | stats count as n", "SELECT count(*) AS n FROM events WHERE lower(event_type) = 'click' OR CAST(value AS VARCHAR) = 'click'")
add("f7_glob", "event_*=p*e OR event_type=vie? | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM events WHERE regexp_full_match(event_type, 'p.*e', 'i') OR regexp_full_match(event_type, 'vie.', 'i') GROUP BY event_type")
add("f8_bare_glob", "licen?ed | stats count as n by lang", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_-])licen[A-Za-z0-9_-]ed($|[^A-Za-z0-9_-])', 'i') OR len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: regexp_full_match(x, 'licen.ed', 'is'))) > 0 GROUP BY lang", texts)
add("f9_regex", "/licen[sc]ed? under/ | stats count as n by lang", "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, 'licen[sc]ed? under', 'i') GROUP BY lang", texts)
add("f10_expression", "len(event_type) > 5 | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM events WHERE strlen(event_type) > 5 GROUP BY event_type")
add("f11_boolean", "(event_type=click OR event_type=view) NOT value>50 | stats count as n, sum(value) as s by event_type", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events WHERE event_type IN ('click', 'view') AND NOT coalesce(value > 50, false) GROUP BY event_type", digits=4)
add("f11_not_missing", "NOT nosuch=1 | stats count as n", "SELECT count(*) AS n FROM events")
add("f12_first_class", "ingest_seq>=100 ingest_seq<200 | stats count as n", "SELECT count(*) AS n FROM events WHERE event_id >= 100 AND event_id < 200")
add("f13_timestamp", 'ingest_ts>="2024-01-05T00:00:00Z" ingest_ts<"2024-01-07T12:00:00Z" | stats count as n', "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 12:00:00'")
add("f13_timestamp_equals", 'ingest_ts="2024-01-01T00:09:58Z" | stats count as n', "SELECT count(*) AS n FROM events WHERE date_trunc('second', ts) = TIMESTAMP '2024-01-01 00:09:58'")


def two_vaults(spark: SparkSession, sf_dir: str) -> Records:
    df = read(spark, sf_dir, "events").drop("props")
    return union(promote(df, "ts", "event_id", vault="hot"), promote(df.where("event_id % 2 = 0"), "ts", "event_id", vault="cold"))


add("f14_vault", "vault_id=cold OR (vault_id=hot event_type=error) | stats count as n by event_type", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type FROM events WHERE event_type = 'error') GROUP BY event_type", two_vaults)
add("f16_source_bounds", "source_start=2024-01-03T00:00:00Z source_end=2024-01-04T00:00:00Z | stats count as n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'",
    lambda s, d: promote(read(s, d, "events").drop("props").withColumn("src", F.col("ts")), "ts", "event_id", source_ts="src"))
add("f17_ingest_bounds", "start=2024-01-03T00:00:00Z end=2024-01-04T00:00:00Z event_type=click | stats count as n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' AND event_type = 'click'")
add("f18_position", "pos=7 | fields event_id", "SELECT event_id FROM events WHERE event_id = 7", lambda s, d: Records(events(s, d).df.withColumn("pos", F.col("ingest_seq")), events(s, d).promoted, "none"), columns=["event_id"])

# --- transforms --------------------------------------------------------------------------

EVENTS = ["event_id", "user_id", "event_type", "value"]
add("p1_where", "event_type=click | where value>100 OR user_id<3", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' AND (value > 100 OR user_id < 3)", columns=EVENTS)
add("p1_where_table", "| stats count as n by user_id | where n>20", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 20")
add("p2_eval", "| eval x = value * 2 + 1, y = x % 7, z = -y | fields event_id, x, y, z", "SELECT event_id, round(value * 2 + 1, 6) AS x, round(fmod(value * 2 + 1, 7), 6) AS y, round(-fmod(value * 2 + 1, 7), 6) + 0 AS z FROM events", columns=["event_id", "x", "y", "z"], digits=6)
add("p2_eval_keeps_old", "| eval event_type = nosuch, value = tonumber(event_type) | fields event_id, event_type, value", "SELECT event_id, event_type, value FROM events", columns=["event_id", "event_type", "value"])
add("p3_sort_head", "| sort -value, event_id | head 10", "SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10", columns=EVENTS)
add("p4_head", "event_type=view | head 25", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 25", columns=EVENTS)
add("p5_tail", "event_type=view | tail 7", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 7", columns=EVENTS)
add("p6_slice", "| sort user_id, value | slice 11 30", "SELECT event_id, user_id, event_type, value FROM events ORDER BY user_id, value, ts, event_id LIMIT 20 OFFSET 10", columns=EVENTS)
add("p7_rename", "| rename event_type as kind, value as amount | where kind=error | stats sum(amount) as total by kind", "SELECT event_type AS kind, round(sum(value), 4) AS total FROM events WHERE event_type = 'error' GROUP BY event_type", digits=4)
add("p8_fields", "event_type=error | fields - user_id | fields event_id, value", "SELECT event_id, value FROM events WHERE event_type = 'error'", columns=["event_id", "value"])


def twice(spark: SparkSession, sf_dir: str) -> Records:
    """Events and a copy of each, half of them written 0.5 s later, half 2 s."""
    df = read(spark, sf_dir, "events").drop("props")
    base = promote(df, "ts", "event_id")
    late = base.df.withColumn("write_ts", F.col("write_ts") + F.expr("CASE WHEN ingest_seq % 2 = 0 THEN INTERVAL 0.5 SECOND ELSE INTERVAL 2 SECOND END")).withColumn("vault_id", F.lit("other"))
    return Records(base.df.unionByName(late), base.promoted, "none")


add("p9_dedup", "| dedup 1s | stats count as n by event_type", "SELECT event_type, count(*) + count(*) FILTER (WHERE event_id % 2 = 1) AS n FROM events GROUP BY event_type", twice)


def nations(spark: SparkSession, sf_dir: str) -> dict:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return {"nations": Table(nation, ("n_nationkey",), ("name", "region"))}


add("p10_lookup", "| lookup nations c_nationkey | stats count as n, avg(c_acctbal) as a by c_nationkey_name",
    "SELECT n_name AS c_nationkey_name, count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", lambda s, d: rows(s, d, "customer"), digits=4, lookups=nations)


def supply(spark: SparkSession, sf_dir: str) -> dict:
    line = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("most"))
    return {"supply": Table(line, ("l_partkey", "l_suppkey"), ("most",), unique=True)}


add("j_lookup_two_keys", "l_returnflag=R | lookup supply l_partkey l_suppkey | stats count as n, sum(supply_most) as s by l_linestatus",
    "SELECT l_linestatus, count(*) AS n, sum(most) AS s FROM lineitem JOIN (SELECT l_partkey AS p, l_suppkey AS q, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2) ON l_partkey = p AND l_suppkey = q WHERE l_returnflag = 'R' GROUP BY l_linestatus", lines, lookups=supply)
add("j_lookup_miss", "| eval k = user_id + 1000000 | lookup users k | where NOT k_balance=* | stats count as n", "SELECT count(*) AS n FROM events",
    lookups=lambda s, d: {"users": Table(read(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")), ("c_custkey",), ("balance",))})


def addresses(spark: SparkSession, sf_dir: str) -> Records:
    df = read(spark, sf_dir, "events").drop("props")
    return promote(df.withColumn("ip", F.concat(F.lit("10."), (F.col("user_id") % 200).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".9"))), "ts", "event_id")


def ranges(spark: SparkSession, sf_dir: str) -> dict:
    base = 10 * 2**24
    df = spark.range(50).select((F.lit(base) + F.col("id") * 4 * 65536).alias("lo"), (F.lit(base) + (F.col("id") * 4 + 3) * 65536 + 65535).alias("hi"), F.concat(F.lit("net"), F.col("id").cast("string")).alias("country"))
    return {"geo": Ranges(df, "lo", "hi", ("country",))}


add("j_lookup_ranges", "| lookup geo ip | stats count as n by ip_country", "SELECT 'net' || CAST((user_id % 200) // 4 AS VARCHAR) AS ip_country, count(*) AS n FROM events GROUP BY 1", addresses, lookups=ranges)
add("j_lookup_function", "| lookup shout event_type | stats count as n by event_type_loud", "SELECT upper(event_type) AS event_type_loud, count(*) AS n FROM events GROUP BY 1",
    lookups=lambda s, d: {"shout": Function(lambda x: x.str.upper().to_frame("loud"), ("loud",))})
add("p11_raw", "event_type=error | raw", "SELECT ts AS write_ts, ts AS ingest_ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, user_id, value, props AS raw FROM events WHERE event_type = 'error'", json_events)
QUERIES["p11_raw"] = lambda s, d, run=QUERIES["p11_raw"]: run(s, d).withColumn("write_ts", F.col("write_ts").cast("timestamp_ntz"))

# --- aggregation -------------------------------------------------------------------------

add("a_numeric", "| stats count as n, count(l_discount) as c, sum(l_quantity) as s, avg(l_extendedprice) as a, min(l_tax) as lo, max(l_extendedprice) as hi by l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_discount) AS c, sum(l_quantity) AS s, round(avg(l_extendedprice), 4) AS a, min(l_tax) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2", lines, digits=4)
add("a7_dcount", "| stats dcount(l_suppkey) as d, dcount(l_partkey) as e by l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(DISTINCT l_partkey) AS e FROM lineitem GROUP BY 1", lines)
add("a8_median", "| stats median(l_extendedprice) as m by l_linestatus", "SELECT l_linestatus, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1", lines, digits=4)
add("a9_first_last", "| stats first(value) as f, last(event_type) as l by user_id", "SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l FROM events GROUP BY user_id")
add("a11_values", "| stats values(event_type) as v by user_id", "SELECT user_id, string_agg(event_type, ', ' ORDER BY o) AS v FROM (SELECT user_id, event_type, min((ts, event_id)) AS o FROM events GROUP BY 1, 2) GROUP BY user_id")
add("a12_expression", "| stats sum(l_extendedprice * (1 - l_discount)) as revenue by l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1", lines, digits=2)
add("a14_group_missing", "| stats count as n by nosuch", "SELECT '' AS nosuch, count(*) AS n FROM events")
_BIN = "((epoch_us(ts) + 62135596800000000) // {w}) * {w} - 62135596800000000"
add("a15_bin_gaps", "| stats count as n, sum(value) as s by bin(7m), event_type", f"""
WITH c AS (SELECT {_BIN.format(w=420000000)} AS b, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2),
g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), 420000000)) AS b), t AS (SELECT DISTINCT event_type FROM c)
SELECT make_timestamp(g.b) AS _time, t.event_type, coalesce(n, 0) AS n, s FROM g CROSS JOIN t LEFT JOIN c ON c.b = g.b AND c.event_type = t.event_type""", digits=4)  # fmt: skip
add("a15_bin_week", "| stats count as n by bin(7d)", f"""
WITH c AS (SELECT {_BIN.format(w=604800000000)} AS b, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), 604800000000)) AS b)
SELECT make_timestamp(g.b) AS _time, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (b)""")  # fmt: skip
add("a16_gap_bounds", "start=2024-01-02T00:00:00Z end=2024-01-03T00:00:00Z | stats count as n by bin(1h)", f"""
WITH c AS (SELECT {_BIN.format(w=3600000000)} AS b, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' GROUP BY 1),
g AS (SELECT unnest(generate_series(epoch_us(TIMESTAMP '2024-01-02'), epoch_us(TIMESTAMP '2024-01-03'), 3600000000)) AS b)
SELECT make_timestamp(g.b) AS _time, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (b)""")  # fmt: skip
add("a17_nothing", "event_type=nosuch | stats count as n, sum(value) as s", "SELECT count(*) AS n, sum(value) AS s FROM events WHERE event_type = 'nosuch'")
add("a17_nothing_grouped", "event_type=nosuch | stats count as n by user_id", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'nosuch' GROUP BY user_id")

# --- histograms --------------------------------------------------------------------------

_CHART = """
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), w AS (SELECT lo, hi, greatest((hi - lo) * 1000 // {n}, 1) AS w FROM b),
c AS (SELECT least((epoch_us(ts) - lo) * 1000 // w, {n} - 1) AS b, {by} AS g, count(*) AS count FROM events, w {where} GROUP BY 1, 2),
g AS (SELECT unnest(range({n})) AS b) SELECT make_timestamp(lo + g.b * w // 1000) AS _time, {out} coalesce(count, 0) AS count FROM g CROSS JOIN w LEFT JOIN c USING (b)"""
add("h1_timechart", "| timechart 24", _CHART.format(n=24, by="''", out="", where=""))
add("h4_timechart_by", "| timechart 50 by event_type", _CHART.format(n=50, by="event_type", out="coalesce(g, '') AS event_type,", where=""))
add_function("h9_volume", lambda s, d: api.histogram(events(s, d), "", 20), _CHART.format(n=20, by="'other'", out="coalesce(g, '') AS level,", where=""))

# --- scalar functions --------------------------------------------------------------------

add("x_math", "| eval a = abs(value - 50), b = ceil(value), c = floor(value), d = sqrt(value), e = exp(value / 100), f = pow(value, 2), g = round(value, 1), h = log(value + 1), i = log10(value + 1), j = log2(value + 1) | fields event_id, a, b, c, d, e, f, g, h, i, j",
    "SELECT event_id, round(abs(value - 50), 6) AS a, ceil(value) AS b, floor(value) AS c, round(sqrt(value), 6) AS d, round(exp(value / 100), 6) AS e, round(value * value, 6) AS f, round(floor(value * 10 + 0.5) / 10, 6) AS g, round(ln(value + 1), 6) AS h, round(log10(value + 1), 6) AS i, round(log2(value + 1), 6) AS j FROM events",
    columns=["event_id", *"abcdefghij"], digits=6)
add("x_text", '| eval a = len(event_type), b = upper(event_type), c = lower(b), d = substr(event_type, 1, 3), e = replace(event_type, "i", "II"), f = trim(concat("  ", event_type, " ")), g = concat(event_type, "-", user_id) | fields event_id, a, b, c, d, e, f, g',
    "SELECT event_id, CAST(strlen(event_type) AS DOUBLE) AS a, upper(event_type) AS b, event_type AS c, substr(event_type, 2, 3) AS d, replace(event_type, 'i', 'II') AS e, event_type AS f, event_type || '-' || CAST(user_id AS VARCHAR) AS g FROM events", columns=["event_id", *"abcdefg"])
add("x_control", '| eval a = coalesce(nosuch, event_type), b = isnull(nosuch), c = isnull(value), d = typeof(value), e = typeof(event_type), f = typeof(nosuch), g = tonumber("12.5"), h = tostring(user_id) | fields event_id, a, b, c, d, e, f, g, h',
    "SELECT event_id, event_type AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 'number' AS d, 'string' AS e, 'missing' AS f, 12.5::DOUBLE AS g, CAST(user_id AS VARCHAR) AS h FROM events", columns=["event_id", *"abcdefgh"])
add("x_bits", "| eval a = bitand(user_id, 6), b = bitor(user_id, 9), c = bitxor(user_id, 5), d = bitnot(user_id), e = bitshl(user_id, 3), f = bitshr(user_id, 1), g = bitshl(user_id, 64) | fields event_id, a, b, c, d, e, f, g",
    "SELECT event_id, CAST(user_id & 6 AS DOUBLE) AS a, CAST(user_id | 9 AS DOUBLE) AS b, CAST(xor(user_id, 5) AS DOUBLE) AS c, CAST(-user_id - 1 AS DOUBLE) AS d, CAST(user_id << 3 AS DOUBLE) AS e, CAST(user_id >> 1 AS DOUBLE) AS f, 0.0::DOUBLE AS g FROM events", columns=["event_id", *"abcdefg"])
add("x_arithmetic", "| eval a = value + user_id, b = value - 1, c = value * user_id, d = value / 4, e = value % 3, f = -value | fields event_id, a, b, c, d, e, f",
    "SELECT event_id, round(value + user_id, 6) AS a, round(value - 1, 6) AS b, round(value * user_id, 6) AS c, round(value / 4, 6) AS d, round(fmod(value, 3), 6) AS e, round(-value, 6) + 0 AS f FROM events", columns=["event_id", *"abcdef"], digits=6)

# --- order, union, pages, context --------------------------------------------------------

add("m1_reverse_limit", "reverse=true limit=15 event_type=click", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 15", columns=EVENTS)
add("m2_union", "| stats count as n by event_type", "SELECT event_type, count(*) + count(*) FILTER (WHERE event_id % 2 = 0) AS n FROM events GROUP BY 1", two_vaults)
add_function("m6_search_then_follow", lambda s, d: api.search_then_follow(events(s, d), "event_type=purchase value>150").select(*EVENTS),
    "SELECT event_id, user_id, event_type, value FROM events WHERE (ts, event_id) >= (SELECT min((ts, event_id)) FROM events WHERE event_type = 'purchase' AND value > 150)")
add_function("m7_with_context", lambda s, d: api.with_context(events(s, d), "event_type=error value>150", 2, 1).select("match_no", "offset", "event_id"),
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) SELECT h.rn AS match_no, CAST(r.rn - h.rn AS INTEGER) AS \"offset\", r.event_id FROM n h JOIN n r ON r.rn BETWEEN h.rn - 2 AND h.rn + 1 WHERE h.event_type = 'error' AND h.value > 150")
add_function("m8_context", lambda s, d: api.context(events(s, d), {"ingest_ts": datetime(2024, 1, 5, tzinfo=UTC), "ingest_seq": -1}, 5, 5).select(*EVENTS),
    "SELECT * FROM (SELECT event_id, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT event_id, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' ORDER BY ts, event_id LIMIT 5)")
add_function("m9_fields", lambda s, d: api.fields(events(s, d), "event_type=* | fields event_type", 500).where("key = 'event_type'"),
    "SELECT 'attr' AS kind, 'event_type' AS key, event_type AS value, count(*) AS value_count, CAST(sum(count(*)) OVER () AS BIGINT) AS key_count FROM (SELECT event_type FROM events ORDER BY ts, event_id LIMIT 500) GROUP BY event_type")

# --- ingest, routing, retention ----------------------------------------------------------


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("at=1 severity: "), F.col("event_type"), F.lit(" done"))
    df = read(spark, sf_dir, "events").select(raw.alias("raw"))
    return df.groupBy(F.coalesce(digest.level(F.col("raw")), F.lit("none")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("x "), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] then 2020-01-01T00:00:00Z")).alias("raw"))
    return df.select("event_id", digest.source_time(F.col("raw"), EPOCH).cast("timestamp_ntz").alias("source_ts"))


ROUTES = [sinks.Route("errors", "event_type=error"), sinks.Route("big", "value>150"), sinks.Route("all", "*"), sinks.Route("rest", "+"), sinks.Route("none", "")]


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = events(spark, sf_dir)
    return sinks.route(records.df, ROUTES, records.promoted).groupBy("vault_id").agg(F.count(F.lit(1)).alias("n"))


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select(F.lit("main").alias("vault_id"), F.date_format("o_orderdate", "yyyy-MM").alias("chunk_id"), F.col("o_orderdate").alias("at"))
    chunks = df.groupBy("vault_id", "chunk_id").agg(F.max("at").alias("write_end"), (F.count(F.lit(1)) * 100).alias("bytes"))
    return retention.expired(chunks, retention.Retention(most_bytes=50_000, most_chunks=40, ttl=timedelta(days=365 * 40)), EPOCH).select("chunk_id", "bytes")


add_function("g1_level", levels, "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'none' END AS level, count(*) AS n FROM events GROUP BY 1")
add_function("g2_source_time", source_times, "SELECT event_id, date_trunc('second', ts) AS source_ts FROM events")
add_function("g4_route", routed, "SELECT vault_id, count(*) AS n FROM (SELECT 'errors' AS vault_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'big' FROM events WHERE value > 150 UNION ALL SELECT 'all' FROM events UNION ALL SELECT 'rest' FROM events WHERE NOT (event_type = 'error' OR value > 150)) GROUP BY 1")
add_function("m14_retention", expired, """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS chunk_id, max(o_orderdate) AS e, count(*) * 100 AS bytes FROM orders GROUP BY 1),
r AS (SELECT *, sum(bytes) OVER (ORDER BY e DESC, chunk_id) AS b, row_number() OVER (ORDER BY e DESC, chunk_id) AS n FROM c)
SELECT chunk_id, bytes FROM r WHERE b > 50000 OR n > 40 OR e < TIMESTAMP '2024-01-01' - INTERVAL 14600 DAY""")  # fmt: skip
add_function("p21_chart", lambda s, d: s.createDataFrame([(api.search(events(s, d), "| stats count by event_type").chart(),)], "chart string"), "SELECT CASE WHEN count(DISTINCT event_type) BETWEEN 2 AND 12 THEN 'donut' ELSE 'table' END AS chart FROM events")

from timberline import catalog_io as _  # noqa: E402, F401
