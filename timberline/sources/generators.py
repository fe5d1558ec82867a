"""Deterministic record generators: sequence records and log lines of several families, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.readers import _attrs, standard

LEVELS = ("DEBUG", "INFO", "INFO", "INFO", "WARN", "ERROR")
METHODS, PATHS, HOSTS = ("GET", "POST", "PUT", "DELETE"), ("/", "/api/users", "/api/orders", "/health"), ("web-1", "web-2", "db-1")
WORDS = ("request completed", "connection reset", "cache miss", "job started", "slow query")
FAMILIES = ("plain", "kv", "json", "access", "syslog", "weird", "multirecord")


def _pick(n: Column, salt: int, options: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))


def _number(n: Column, salt: int, below: int) -> Column:
    return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(below))


def line(n: Column, family: str) -> Column:
    """The n-th line of a family."""
    level, method, path, host, words = _pick(n, 1, LEVELS), _pick(n, 2, METHODS), _pick(n, 3, PATHS), _pick(n, 4, HOSTS), _pick(n, 5, WORDS)
    status, ms = 200 + 100 * _number(n, 6, 4), _number(n, 7, 5000)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    match family:
        case "plain":
            return text(level, " ", words, " on ", host)
        case "kv":
            return text("level=", level, ' msg="', words, '" method=', method, " path=", path, " status=", status, " latency_ms=", ms)
        case "json":
            return F.to_json(F.struct(level.alias("level"), words.alias("msg"), F.struct(method.alias("method"), path.alias("path")).alias("request"), F.struct(status.alias("status"), ms.alias("ms")).alias("response")))
        case "access":
            return text("10.0.0.", _number(n, 8, 255), " - - [01/Jan/2025:00:00:00 +0000] \"", method, " ", path, " HTTP/1.1\" ", status, " ", ms, ' "-" "curl/8.0"')
        case "syslog":
            return text("<", 8 + _number(n, 9, 150), ">Jan  2 03:04:05 ", host, " app[", _number(n, 10, 9999), "]: ", words)
        case "weird":
            return text("\t==", words, "== \\x00 {", n, " ]]")
        case "multirecord":
            return text(words, "\n  at frame ", _number(n, 11, 20), "\n  at frame ", _number(n, 12, 20))
    raise ValueError(f"unknown family {family}")


def mixed(n: Column, weights: dict[str, int]) -> Column:
    """A line whose family is drawn by weight."""
    total, at, out = sum(weights.values()), 0, None
    draw = _number(n, 0, total)
    for family, w in weights.items():
        at += w
        out = F.when(draw < at, line(n, family)) if out is None else out.when(draw < at, line(n, family))
    return out


def chatter(spark: SparkSession, rows: int | None = None, weights: dict[str, int] | None = None, per_second: int = 10, service: str = "demo") -> DataFrame:
    """Generated log records: ``rows`` of them, or a stream at a rate."""
    df = spark.range(rows).select(F.col("id").alias("value")) if rows is not None else spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    raw = mixed(F.col("value"), weights or dict.fromkeys(FAMILIES, 1))
    return standard(df, raw, _attrs(service=F.lit(service), host=_pick(F.col("value"), 4, HOSTS)), ingester="chatter")


def sequence(spark: SparkSession, rows: int | None = None, per_second: int = 10, node: str = "node-1") -> DataFrame:
    """Numbered records, to trace loss and duplication."""
    if rows is not None:
        df = spark.range(rows).select(F.col("id").alias("value"), (F.timestamp_seconds(F.lit(1735689600) + F.col("id"))).alias("timestamp"))
    else:
        df = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    body = F.to_json(F.struct(F.col("value").alias("seq"), F.col("timestamp").alias("generated_at"), F.lit("sequence").alias("ingester"), F.lit(node).alias("node")))
    return standard(df, body, _attrs(seq=F.col("value"), node=F.lit(node)), ingester="sequence", now=F.col("timestamp"))


def vault_metrics(records: DataFrame) -> DataFrame:
    """One k=v record per vault about its size."""
    sizes = records.groupBy("vault_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("bytes"))
    raw = F.concat(F.lit("record_count="), F.col("n").cast("string"), F.lit(" data_bytes="), F.coalesce("bytes", F.lit(0)).cast("string"))
    return standard(sizes, raw, _attrs(metric_type=F.lit("vault"), vault_id=F.col("vault_id"), level=F.lit("info")), ingester="metrics")


def system_metrics(spark: SparkSession) -> DataFrame:
    """One k=v record per executor (and driver) about its memory, as the block manager knows it."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    found, names = [], status.keysIterator()
    while names.hasNext():
        name = names.next()
        most, free = status.apply(name)._1(), status.apply(name)._2()
        found.append((name, most, most - free))
    df = spark.createDataFrame(found, "executor string, most long, used long")
    raw = F.concat(F.lit("memory_max_bytes="), F.col("most").cast("string"), F.lit(" memory_used_bytes="), F.col("used").cast("string"))
    return standard(df, raw, _attrs(metric_type=F.lit("system"), executor=F.col("executor"), level=F.lit("info")), ingester="metrics")
