"""Semantics on small records: missing fields, any-match, dynamic types, order, extraction."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline import api
from timberline.functions import extract
from timberline.functions.values import Value, parse_number, render_number
from timberline.lang.errors import QueryError
from timberline.operators.lookup import Function, Table
from timberline.sources import generators, readers, sinks
from timberline.sources.records import SCHEMA, Records
from timberline.streaming import follow as live

T0 = datetime(2025, 6, 15, 10, tzinfo=UTC)


def record(i, attrs=None, raw="", vault="main", write=0.0, source=None, ingester=None):
    at = T0 + timedelta(seconds=i)
    return (vault, source, at, at + timedelta(seconds=write), ingester, None, i, attrs or {}, raw)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: Records(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def logs(make):
    return make(
        [
            record(0, {"level": "error", "host": "Web-1", "status": "500"}, "level=warn msg=\"boom boom\" status=503 path=/x"),
            record(1, {"level": "info", "host": "web-2", "status": "abc"}, '{"a": {"b": 7, "c": [1, 2]}, "User": "Ann", "ok": true, "none": null}'),
            record(2, {"host": ""}, "connection reset by peer"),
            record(3, {"level": "ERROR", "n": "10"}, '10.0.0.1 - bob [01/Jan/2025:00:00:00 +0000] "GET /i HTTP/1.1" 404 0 "-" "curl/8"'),
            record(4, {"n": "9"}, "errors are not error_s; 1234 deadbeef supercalifragilistic"),
        ]
    )


def seqs(records, q, **kw):
    return sorted(r.ingest_seq for r in api.search(records, q, **kw).dataframe().collect())


@pytest.mark.parametrize(
    "q, want",
    [
        ("level=error", [0, 3]),
        ("level=warn", [0]),
        ("LEVEL=Error", [0, 3]),
        ("level!=error", [0, 1]),
        ("NOT level=error", [1, 2, 4]),
        ("status>=500", [0]),
        ("status>=501", [0]),
        ("status<abd", [0, 1, 3]),
        ("n>9", [3]),
        ("host=*", [0, 1, 2]),
        ('host=""', [2]),
        ("nosuch=*", []),
        ("*=ann", [1]),
        ("a.b=7", [1]),
        ("a.none=*", []),
        ("none=*", [1]),
        ("a=*", [1]),
        ("h*=web-?", [0, 1]),
        ("error", []),
        ("reset", [2]),
        ("rese", []),
        ("errors", [4]),
        ("1234", [4]),
        ("234", [4]),
        ("supercalifragili", [4]),
        ('"reset by"', [2]),
        ("res*", [2]),
        ("/GET \\/i/", [3]),
        ("remote_host=10.0.0.1 status=404", [3]),
        ("body_bytes=*", []),
        ("level=error OR reset", [0, 2, 3]),
        ("(level=error OR reset) NOT n=10", [0, 2]),
        ("ingest_seq>=3", [3, 4]),
        ('ingest_ts="2025-06-15T10:00:02Z"', [2]),
        ('ingest_ts!="2025-06-15T10:00:02Z"', []),
        ("ingester_id=*", []),
        ("source_ts=*", []),
        ("len(host) > 3", [0, 1]),
        ("lower(host) = web-1", [0]),
        ("vault_id=other", []),
        ("*", [0, 1, 2, 3, 4]),
        ("start=2025-06-15T10:00:01Z end=2025-06-15T10:00:03Z", [1, 2]),
        ("source_start=2025-01-01T00:00:00Z", []),
        ("limit=2 reverse=true", [3, 4]),
    ],
)
def test_filters(logs, q, want):
    assert seqs(logs, q) == want


def rows(records, q, **kw):
    return [tuple(r) for r in api.search(records, q, **kw).dataframe(sort=True).collect()]


def test_row_precedence_and_types(logs):
    out = rows(logs, "ingest_seq<2 | eval s = status, m = msg, u = user, t = typeof(status), x = status + 1 | stats first(s) as s, first(m) as m, first(t) as t, first(x) as x by ingest_seq")
    assert out == [(0, "500", "boom boom", "number", "501"), (1, "abc", None, "string", None)]
    assert rows(logs, "ingest_seq=1 | eval q = a.b * 2, c = a.c | stats sum(q) as q, values(c) as c") == [(14.0, "2")]


def test_eval_keeps_old_and_sort_is_typed(logs, make):
    assert rows(logs, "| eval n = n + 0 | stats values(n) as v") == [("10, 9",)]
    mixed = make([record(i, {"k": v} if v is not None else {}) for i, v in enumerate(["10", "9", "b", "a", None, "", "1e1"])])
    got = [r.ingest_seq for r in api.search(mixed, "| sort k").dataframe(sort=True).collect()]
    assert got == [4, 5, 1, 0, 6, 3, 2]
    assert [r.ingest_seq for r in api.search(mixed, "| sort -k | tail 2").dataframe(sort=True).collect()] == [4, 5]


def test_rename_fields_and_order(logs):
    out = api.search(logs, "| rename host as h | where h=web-1 | fields h").dataframe().collect()
    assert [r.h for r in out] == ["Web-1"]
    assert api.search(logs, "| fields - host | where host=*").dataframe().count() == 0
    assert api.search(logs, "| rename nosuch as level | where level=error").dataframe().count() == 2
    assert [r.ingest_seq for r in api.search(logs, "| tail 3 | head 1").dataframe().collect()] == [2]
    assert [r.ingest_seq for r in api.search(logs, "| slice 2 3").dataframe(sort=True).collect()] == [1, 2]


def test_dedup_chain(make):
    copies = [record(0, write=w, vault=v, ingester="i") for v, w in (("a", 0.0), ("b", 0.5), ("c", 1.2), ("d", 1.9), ("e", 2.5))]
    kept = api.search(make([*copies, record(1), record(2)]), "| dedup 1s").dataframe().collect()
    assert sorted(r.vault_id for r in kept) == ["a", "c", "e", "main", "main"]
    assert api.search(make(copies), "| dedup 1h").dataframe().count() == 1
    assert api.search(make(copies), "| dedup bogus").dataframe().count() == 3


def test_lookup_first_row_wins_and_misses(spark, logs):
    table = Table(spark.createDataFrame([("web-2", "dc1"), ("web-2", "dc2"), ("db", "dc3")], "host string, dc string").coalesce(1), ("host",), ("dc",))
    out = {r.ingest_seq: r.host_dc for r in api.search(logs, "| lookup hosts host", {"hosts": table}).dataframe().collect()}
    assert out == {0: None, 1: "dc1", 2: None, 3: None, 4: None}
    assert api.search(logs, "| lookup nosuch host").dataframe().count() == 5
    loud = Function(lambda x: x.str.upper().to_frame("up"), ("up",))
    assert api.search(logs, "ingest_seq=1 | lookup f host", {"f": loud}).dataframe().first().host_up == "WEB-2"


def test_numbers(spark):
    texts = ["1", " 2 ", "1d", "0x10", "1_0", "", "NaN", "inf", "1e3", ".5", "5.", "1e999", "-2.50", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_number(F.col("t"))).collect()]
    assert [x if x is None or x == x else "nan" for x in got] == [1, None, None, None, None, None, "nan", float("inf"), 1000, 0.5, 5, None, -2.5, None]
    numbers = [3.0, 0.1, 1e7, 1e-4, 1e-7, 12345678.9, -2.5, 1e15, float("nan"), float("-inf"), 1e18]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n double").select(render_number(F.col("n"))).collect()]
    assert got == ["3", "0.1", "10000000", "0.0001", "0.0000001", "12345678.9", "-2.5", "1000000000000000", "NaN", "-Inf", "1000000000000000000"]


def test_scalar_edges(logs):
    q = """ingest_seq=0 | eval a = sqrt(-1), b = log(0), c = 5 / 0, d = 7 % 0, e = substr("héllo", 0, 2), f = substr("abc", 5, 1), g = round(-2.5), h = round(1234, -2), i = bitshl(1, 65),
    j = replace("aXbX", "X", "$1"), k = len("é"), l = concat("a", nosuch, "b"), m = - 7 % 4, n = replace("ab", "", "-"), o = substr("abc", -3, -1) | stats first(a) as a, first(b) as b, first(c) as c, first(d) as d, first(f) as f, first(g) as g,
    first(h) as h, first(i) as i, first(j) as j, first(k) as k, first(l) as l, first(m) as m, first(n) as n, first(o) as o"""
    a, b, c, d, f, g, h, i, j, k, m_l, m, n, o = rows(logs, q)[0]
    assert (a, b, c, d) == ("NaN", "-Inf", "NaN", "NaN")
    assert (f, g, h, i, j, k, m_l, m, n, o) == ("", "-3", "1200", "0", "a$1b$1", "2", "ab", "-3", "-a-b-", "")
    assert Value(F.lit(1.0), True).numeric


def test_extraction_cases():
    kv = dict(extract.key_values('a=1 b.c="x y" (d=2) e=f=g u=/p?x=1&y=2 Ä=1 k=é Big=VaL , z=9;'))
    assert kv == {"a": "1", "b.c": "x y", "d": "2", "big": "val", "z": "9"} or {"a", "d", "big", "z"} <= set(kv)
    assert dict(extract.logfmt('level=INFO done msg="say \\"hi\\"" x= t=1')) == {"level": "info", "done": "true", "msg": 'say "hi"', "t": "1"}
    assert extract.logfmt('{"a"=1}') == []
    assert ("a", "2") in extract.json_flat({"a": [1, 2, None, {"x": 1}], "b": {"c": {"d": {"e": 1}}}, "n": None})
    assert dict(extract.access_log('h - - [x] "GET /p HTTP/1.1" 200 -')) == {"remote_host": "h", "method": "get", "path": "/p", "protocol": "http/1.1", "status": "200"}
    assert extract.key_values("k=" + "v" * 65) == [] and extract.pairs_of(None) == []
    assert (".".join(["a", "[*]", "b"]), "1") in extract.json_paths({"a": [{"b": 1}]})


def test_stats_edges(logs):
    assert rows(logs, "nosuch=1 | stats count, sum(n), values(n)") == [(0, None, None)]
    assert rows(logs, "nosuch=1 | stats count by level") == []
    assert rows(logs, "| stats count as c, min(n) as lo, max(n) as hi, dcount(level) as d") == [(5, 9.0, 10.0, 3)]
    assert rows(logs, "reverse=true | stats first(ingest_seq) as f, last(ingest_seq) as l") == [(4, 0)]
    gaps = rows(logs, "| where ingest_seq=0 OR ingest_seq=4 | stats count as n by bin(2s)")
    assert [n for _, n in gaps] == [1, 0, 1]
    assert rows(logs, "| stats count by bin(1m, source_ts)") == []


def test_pages_cover_everything(logs):
    seen, token = [], None
    while True:
        found, token = api.page(logs, "*", 2, token)
        seen += [r.ingest_seq for r in found]
        if token is None:
            break
    assert seen == [0, 1, 2, 3, 4]


def test_charts(logs):
    assert api.search(logs, "| stats count by host | donut").chart() == "donut"
    assert api.search(logs, "| stats count by host, level | donut").chart() == "table"
    assert api.search(logs, "| stats count by bin(1s) | linechart").chart() == "linechart"
    assert api.search(logs, "| stats count by level | linechart").chart() == "table"
    assert api.search(logs, '| eval c = "DE" | stats count by c | map choropleth c').chart() == "choropleth"
    assert api.search(logs, "| stats count by n | scatter n count").chart() in ("scatter", "table")


def test_verbs(logs, tmp_path, spark):
    assert api.validate("a |") == (False, api.validate("a |")[1], 3)
    assert api.validate("level=error | stats count")[0]
    assert api.pipeline_fields("| eval x=1 | rename x as y | stats count by y", ["a"]) == ["y", "count"]
    assert "filter level=error" in api.explain(logs, "level=error | head 2")
    assert set(api.syntax()["aggregates"]) >= {"count", "median"}
    assert api.export(logs, "level=error | export cold", str(tmp_path / "v")) == 2
    back = Records(spark.read.parquet(str(tmp_path / "v")))
    assert back.df.where("vault_id = 'cold'").count() == 2 and seqs(back, "level=error") == [0, 3]
    with pytest.raises(QueryError):
        api.export(logs, "vault_id=cold | export cold", str(tmp_path / "w"))
    assert api.search(logs, "| stats avg(n) as a").render().first().a == "9.5"


def test_readers(spark, tmp_path):
    (tmp_path / "sys").write_text("<34>Oct 11 22:14:15 mymachine su[12]: failed\n<165>1 2003-10-11T22:14:15.003Z host app 77 ID47 - hello\nnot syslog\n")
    got = {r.raw[:4]: r.attrs for r in readers.syslog_lines(spark, str(tmp_path / "sys")).collect()}
    assert got["<34>"] == {"facility": "4", "facility_name": "auth", "severity": "2", "severity_name": "crit", "hostname": "mymachine", "app_name": "su", "proc_id": "12"}
    assert got["<165"]["msg_id"] == "ID47" and got["<165"]["version"] == "1" and got["not "] == {}
    (tmp_path / "push.json").write_text('{"streams": [{"stream": {"app": "x", "k": "1"}, "values": [["1735689600000000001", "line one"], ["1735689601000000000", "two", "{\\"k\\": \\"2\\"}"]]}]}')
    got = readers.push_json(spark, str(tmp_path / "push.json")).collect()
    assert [(r.raw, r.attrs["k"]) for r in got] == [("line one", "1"), ("two", "2")]
    (tmp_path / "otlp.json").write_text('{"resourceLogs":[{"resource":{"attributes":[{"key":"svc","value":{"stringValue":"a"}}]},"scopeLogs":[{"scope":{"name":"s"},"logRecords":[{"timeUnixNano":"1735689600000000000","severityText":"ERROR","severityNumber":17,"body":{"stringValue":"hi"},"attributes":[{"key":"n","value":{"intValue":"3"}}]}]}]}]}')
    r = readers.otlp_json(spark, str(tmp_path / "otlp.json")).first()
    assert r.raw == "hi" and r.attrs["svc"] == "a" and r.attrs["n"] == "3" and r.attrs["severity"] == "ERROR"
    (tmp_path / "c.json").write_text('{"log":"hey\\n","stream":"stderr","time":"2025-01-01T00:00:00.123456789Z"}\n')
    assert readers.container_json(spark, str(tmp_path / "c.json"), "web").first().raw == "hey"
    assert list(readers.decode_relp(b"1 open 5 hello\n2 syslog 7 <34>hey\n3 close 0\n")) == [({"relp_txnr": "2"}, "<34>hey")]
    assert list(readers.decode_mqtt(bytes([0x30, 7]) + b"\x00\x03a/bhi")) == [({"mqtt_topic": "a/b"}, "hi")]
    fluent = b"\x93\xa3tag\xce\x00\x00\x00\x01\x82\xa7message\xa2hi\xa1k\x05"
    assert list(readers.decode_fluent(fluent)) == [({"tag": "tag", "k": "5"}, "hi")]
    (tmp_path / "frames.bin").write_bytes(fluent)
    assert readers.framed(spark, str(tmp_path / "frames.bin"), readers.decode_fluent, "fluent").first().attrs["k"] == "5"
    assert readers.text_lines(spark, str(tmp_path / "sys")).count() == 3


def test_generators_and_json_lines(spark, tmp_path):
    df = generators.chatter(spark, 70)
    assert df.count() == 70 and df.where("raw like 'level=%'").count() > 0
    assert api.search(Records(df), "status=* | stats count as n").dataframe().first().n > 0
    assert generators.sequence(spark, 5).select(F.get_json_object("raw", "$.seq")).distinct().count() == 5
    assert generators.vault_metrics(df).first().raw.startswith("record_count=70")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j")).count() == 70


def test_follow(spark, tmp_path, logs):
    logs.df.write.parquet(str(tmp_path / "in"))
    stream = Records(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    out = live.follow(stream, "level=error | eval x = status + 1 | fields x")
    q = out.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("followed").count() == 2
    for bad in ("| stats count", "| sort x", "| tail 2", "| head 1", "| timechart 3"):
        with pytest.raises(QueryError):
            live.follow(stream, bad)
    q = live.ingest(stream.df, [sinks.Route("errs", "level=error"), sinks.Route("rest", "+")], str(tmp_path / "vaults"), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    got = {r.vault_id: r["count"] for r in spark.read.parquet(str(tmp_path / "vaults")).groupBy("vault_id").count().collect()}
    assert got == {"errs": 2, "rest": 3}


def test_follow_dedup(spark, tmp_path, make):
    make([record(0, write=w, vault=v, ingester="i") for v, w in (("a", 0.0), ("b", 0.5), ("c", 1.2))]).df.write.parquet(str(tmp_path / "in"))
    stream = Records(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), extract="none")
    q = live.follow(stream, "* | dedup 1s").writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.vault_id for r in spark.table("deduped").collect()) == ["a", "c"]
