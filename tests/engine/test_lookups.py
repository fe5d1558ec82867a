from timberline import __main__ as shell
from timberline import api
from timberline.sources import lookups as L
from timberline.sources.records import Records

from tests.engine.test_semantics import SCHEMA, record


def hits(records, table, field, suffix):
    out = api.search(records, f"| lookup t {field}", {"t": table}).dataframe().collect()
    return {r.ingest_seq: r[f"{field}_{suffix}"] for r in out}


def test_tables_and_services(spark, tmp_path):
    agents = ["Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) Version/17.0 Mobile Safari/604.1", "Googlebot/2.1"]
    rows = [record(i, {"host": h, "ip": ip, "ua": ua}) for i, (h, ip, ua) in enumerate(zip(["a", "b", "zz"], ["10.0.0.5", "10.1.0.1", "bad"], agents))]
    logs = Records(spark.createDataFrame([*rows, record(9)], SCHEMA), extract="none")
    (tmp_path / "h.csv").write_text("host;dc\na;one\na;two\nb;three\n")
    assert hits(logs, L.csv_table(spark, str(tmp_path / "h.csv"), delimiter=";"), "host", "dc") == {0: "one", 1: "three", 2: None, 9: None}
    (tmp_path / "h.json").write_text('[{"host": "a", "n": 1, "tags": ["x"]}, {"host": "b", "n": 2, "tags": []}]')
    assert hits(logs, L.json_table(spark, str(tmp_path / "h.json"), "host"), "host", "tags")[0] == '["x"]'
    assert hits(logs, L.static_table(spark, [{"host": "a", "x": "1"}, {"host": "a", "x": "2"}], ("host",)), "host", "x")[0] == "1"
    (tmp_path / "g.csv").write_text("lo,hi,country\n167772160,167837695,DE\n167837696,167903231,FR\n")
    assert hits(logs, L.geo_ranges(spark, str(tmp_path / "g.csv"), ["country"]), "ip", "country") == {0: "DE", 1: "FR", 2: None, 9: None}
    assert hits(logs, L.reverse_dns(lambda ip: "h." + ip if ip[0] == "1" else None), "ip", "hostname") == {0: "h.10.0.0.5", 1: "h.10.1.0.1", 2: None, 9: None}
    service = L.http(lambda url: '{"v": 7}' if url.endswith("/a") else "oops", "http://x.test/{host}", ("v",))
    assert hits(logs, service, "host", "v") == {0: "7", 1: None, 2: None, 9: None}
    assert hits(logs, L.user_agent(), "ua", "device_type") == {0: "desktop", 1: "mobile", 2: "bot", 9: None}
    assert hits(logs, L.user_agent(), "ua", "browser")[0] == "Chrome"


def test_shell(spark, tmp_path, capsys):
    spark.createDataFrame([record(0, {"level": "error"}, "boom"), record(1, {"level": "info"}, "fine")], SCHEMA).write.partitionBy("vault_id").parquet(str(tmp_path / "v"))
    assert shell.main([str(tmp_path / "v"), "level=error", "--format", "raw"]) == 0
    assert capsys.readouterr().out.strip().endswith("boom")
    assert shell.main([str(tmp_path / "v"), "| stats count as n", "--format", "json"]) == 0
    assert '{"n":2}' in capsys.readouterr().out
    assert shell.main([str(tmp_path / "v"), "level=error", "--count"]) == 0
    assert capsys.readouterr().out.strip() == "1"
    assert shell.main([str(tmp_path / "v"), "(", "--count"]) == 2
