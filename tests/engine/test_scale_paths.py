"""Paths that small tables don't reach: time slices, long retry chains, retried batches, lookup files."""

import random
import struct
import tracemalloc
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline import api, catalog_io
from timberline.functions import extract
from timberline.plans.frame import start
from timberline.sources import lookups as L
from timberline.sources import mmdb, readers, sinks
from timberline.sources.records import SCHEMA, Records
from timberline.streaming import follow as live

from tests.engine.test_semantics import T0, record


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(3)
    rows = [("main", None, T0 + timedelta(seconds=rng.choice([0, 0, 5, rng.randrange(4000)])), T0, None, None, i, {"k": str(i % 97)}, "") for i in range(1500)]
    rows += [("main", None, None, T0, None, None, 5000 + i, {"k": "1"}, "") for i in range(7)]
    return Records(spark.createDataFrame(rows, SCHEMA).repartition(7), extract="none"), sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[6]))


def test_slices_number_every_row(many):
    records, rows = many
    frame = start(records, False)
    slices = api.Slices.of(frame, rows=60)
    assert len(slices.bounds) > 5
    got = {r.ingest_seq: r["__n"] for r in slices.numbered(frame).collect()}
    assert got == {r[6]: i for i, r in enumerate(rows, 1)}


@pytest.mark.parametrize("size", [60, 10**6])
def test_context_across_slices(many, monkeypatch, size):
    records, rows = many
    monkeypatch.setattr(api, "SLICE_ROWS", size)
    monkeypatch.setattr(api.Slices.of.__func__, "__defaults__", (size, 4096))
    found = api.with_context(records, "k=13", 70, 3).select("match_no", "offset", "ingest_seq").collect()
    want = [(i, o, rows[i + o - 1][6]) for i, r in enumerate(rows, 1) if r[7]["k"] == "13" for o in range(-70, 4) if 1 <= i + o <= len(rows)]
    assert sorted((r.match_no, r.offset, r.ingest_seq) for r in found) == sorted(want)


@pytest.mark.parametrize("text", ["*", "k=1* reverse=true", "order=ingest_ts k=13"])
@pytest.mark.parametrize("rows", [60, 10**6])
def test_all_pages_at_once(spark, many, monkeypatch, text, rows):
    records, _ = many
    monkeypatch.setattr(api.Slices.of.__func__, "__defaults__", (rows, 4096))
    size = 150
    walked, token = [], None
    while True:
        found, token = api.page(records, text, size, token)
        walked.append([r.ingest_seq for r in found])
        if token is None:
            break
        if len(walked) == 1:
            behind = token
    group = f"pages {text} {rows}"
    spark.sparkContext.setJobGroup(group, group)
    got = sorted(api.pages(records, text, 2).select("page_no", "row_no", "ingest_seq").collect(), key=lambda r: r.row_no)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40  # a walk would take as many as there are pages, up to 750
    flat = [x for p in walked for x in p]
    assert [(r.page_no, r.row_no, r.ingest_seq) for r in got] == [(i // 2, i, x) for i, x in enumerate(flat)]
    if len(walked) > 1:
        assert [r.ingest_seq for r in api.pages(records, text, size, behind).orderBy("row_no").collect()] == flat[size:]


def test_the_query_of_pages_walks_no_further_than_one(spark, monkeypatch):
    calls, page = [], api.page
    monkeypatch.setattr(api, "page", lambda *a, **k: calls.append(a) or page(*a, **k))
    found = sorted(tuple(r) for r in catalog_io.paged(spark, "/root/testdata/sf0.01").collect())
    assert [p for p, _ in found] == list(range(len(found))) and len(found) > 200
    assert len(calls) == 1


def test_dedup_against_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(30):
        times = sorted(rng.sample(range(0, 20_000, 50), rng.choice([1, 3, 40])))
        kept = None
        for t in times:
            rows.append(("main", None, T0, T0 + timedelta(milliseconds=t), None, None, i, {"t": str(t)}, ""))
            if kept is None or t - kept > 1000:
                kept = t
                want.append((i, t))
    rows += [("main", None, None, T0 + timedelta(milliseconds=t), None, None, None, {"t": str(t)}, "") for t in (0, 5, 3000)]
    got = api.search(Records(spark.createDataFrame(rows, SCHEMA).repartition(5), extract="none"), "| dedup 1s").dataframe().collect()
    assert sorted((r.ingest_seq, int(r.attrs["t"])) for r in got if r.ingest_seq is not None) == sorted(want)
    assert sorted(int(r.attrs["t"]) for r in got if r.ingest_seq is None) == [0, 3000]


def test_lines_of_a_stream_are_no_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"line {i}\n" for i in range(20)))
    source = Records(readers.text_lines(spark, str(tmp_path / "in"), stream=True), extract="none")
    q = live.follow(source, "* | dedup 1s").writeStream.format("memory").queryName("tail_lines").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.raw for r in spark.table("tail_lines").collect()) == sorted(f"line {i}" for i in range(20))


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([record(i, {"level": "error" if i % 3 else "info"}) for i in range(30)], SCHEMA)
    routes = [sinks.Route("errs", "level=error")]
    for _ in range(2):
        assert sinks.vault_batch(batch, routes, str(tmp_path / "v"), "s-4") == {"records": 30, "unrouted": 10}
    sinks.vault_batch(batch, routes, str(tmp_path / "v"), "s-5")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 40


def encoded(x):
    """A value in the MaxMind DB data format."""
    head = lambda kind, n: (bytes([kind << 5 | n]) if kind < 8 else bytes([n, kind - 7])) if n < 29 else bytes([kind << 5 | 29, n - 29])
    if isinstance(x, dict):
        return head(7, len(x)) + b"".join(encoded(k) + encoded(v) for k, v in x.items())
    if isinstance(x, list):
        return head(11, len(x)) + b"".join(map(encoded, x))
    if isinstance(x, float):
        return head(3, 8) + struct.pack(">d", x)
    if isinstance(x, int):
        raw = x.to_bytes(4, "big").lstrip(b"\0")
        return head(6, len(raw)) + raw
    return head(2, len(x.encode())) + x.encode()


def database(networks, bits):
    """A file of {(number, prefix length): record} over 128-bit addresses."""
    nodes, data, at = [[None, None]], b"", {}
    for k, rec in networks.items():
        at[k] = len(data)
        data += encoded(rec)
    for (number, length), offset in at.items():
        node = 0
        for i in range(length):
            bit = number >> (127 - i) & 1
            if i == length - 1:
                nodes[node][bit] = ("data", offset)
            else:
                if nodes[node][bit] is None:
                    nodes[node][bit] = len(nodes)
                    nodes.append([None, None])
                node = nodes[node][bit]
    n = len(nodes)
    value = lambda c: n if c is None else n + 16 + c[1] if isinstance(c, tuple) else c
    tree = b""
    for a, b in nodes:
        a, b = value(a), value(b)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    return tree + bytes(16) + data + b"\xab\xcd\xefMaxMind.com" + encoded({"node_count": n, "record_size": bits, "ip_version": 6})


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_mmdb(spark, tmp_path, bits):
    place = {"country": {"iso_code": "DE"}, "city": {"names": {"en": "Ulm"}}, "subdivisions": [{"iso_code": "BW"}], "location": {"latitude": 48.5, "longitude": 10.0, "time_zone": "Europe/Berlin", "accuracy_radius": 20}}
    net = {"autonomous_system_number": 64500, "autonomous_system_organization": "A rather long name of an organisation"}
    nets = {(10 << 24, 96 + 8): place, (0x20010DB8 << 96, 32): net}
    db = mmdb.Database(database(nets, bits))
    assert db.find("10.1.2.3") == place and db.find("::ffff:10.9.9.9") == place and db.find("2001:db8::1") == net
    assert db.find("11.0.0.1") is None and db.find("nonsense") is None and db.find("::1") is None
    if bits != 28:
        return
    (tmp_path / "x.mmdb").write_bytes(database(nets, bits))
    logs = Records(spark.createDataFrame([record(0, {"ip": "10.1.2.3"}), record(1, {"ip": "2001:db8::9"}), record(2, {"ip": "1.1.1.1"})], SCHEMA), extract="none")
    path = str(tmp_path / "x.mmdb")
    out = api.search(logs, "| lookup c ip | lookup a ip", {"c": L.mmdb(path), "a": L.mmdb(path, "asn")}).dataframe().orderBy("ingest_seq").collect()
    assert (out[0].ip_city, out[0].ip_subdivision, out[0].ip_latitude, out[0].ip_accuracy_radius) == ("Ulm", "BW", "48.5000", "20")
    assert out[1].ip_asn == "AS64500" and out[2].ip_city is None and out[2].ip_asn is None


def test_answers_are_remembered_for_a_while():
    now, asked = [0.0], []
    ask = L.Remembered(lambda v: asked.append(v) or ({"x": v} if v == "a" else None), size=2, ttl=10, miss_ttl=2, clock=lambda: now[0])
    assert [ask("a"), ask("a"), ask("b"), ask("b")] == [{"x": "a"}, {"x": "a"}, None, None] and asked == ["a", "b"]
    now[0] = 3.0
    ask("a"), ask("b")
    assert asked == ["a", "b", "b"]


def test_extraction_holds_a_piece_of_a_batch(spark):
    """Python objects of a piece at most, not of all pairs of a batch; pieces end by number and by bytes."""
    texts = [" ".join(f"k{j}={i * j}" for j in range(40)) for i in range(2000)] + [None, "", "x" * 300_000, None, "é=1 ok=2"]
    messages = pa.array(texts)
    tracemalloc.start()
    out = pa.concat_arrays([extract._pairs_array(p) for p in extract._pieces(messages)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    assert [[(p["k"], p["v"], p["s"]) for p in row] for row in out.to_pylist()] == [extract.pairs_of(t) for t in texts]
    assert [len(p) for p in extract._pieces(pa.array([], pa.string()))] == [0]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).select("i", extract.pairs("t").alias("p")).collect()
    assert {r.i: [tuple(p) for p in r.p] for r in got} == {i: extract.pairs_of(t) for i, t in enumerate(texts)}
