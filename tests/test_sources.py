import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import labels as lab
from pulsegrid.operators import alerts as al
from pulsegrid.schema import METRIC_SCHEMA
from pulsegrid.sources import documents, files, outbox as ob, prometheus, serde, snmp, statsd, store

def received():
    return F.timestamp_seconds(F.lit(5000))


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_labels(spark):
    df = spark.createDataFrame([("m", {"b": "2", "a": "1"}), ("m", {"a": "1", "b": "2"}), ("m", None)],
                               "name string, labels map<string,string>")
    keys = [r[0] for r in df.select(lab.label_fingerprint(F.col("name"), F.col("labels"))).collect()]
    assert keys == ["m{a=1,b=2}", "m{a=1,b=2}", "m{}"]
    prints = [r[0] for r in df.select(lab.alert_fingerprint(F.col("name"), F.col("labels"))).collect()]
    import hashlib
    assert prints[0] == prints[1] == hashlib.sha256(b"m|a=1|b=2").hexdigest()[:16]
    assert prints[2] == hashlib.sha256(b"m").hexdigest()[:16]
    merged = [r.labels for r in lab.with_labels(df, {"a": "9", "c": "3"}).collect()]
    assert merged == [{"b": "2", "a": "9", "c": "3"}] * 2 + [{"a": "9", "c": "3"}]


def test_exposition(spark):
    got = prometheus.parse_exposition(lines(
        spark, "# HELP up x", "", 'http_total{method="GET",code="200"} 1027 1395066363000', "plain 3.5",
        "up +Inf", "down -Inf", "none NaN", "bad 12abc", "worse 1d", "9name 1", 'dup{a="1",a="2"} 4', "neg -1.5e3",
        "gauge{} 7", "  spaced   8  ", "a 1 2 3"), received=received())
    rows = {r.name: r for r in got.collect()}
    assert set(rows) == {"http_total", "plain", "up", "down", "none", "dup", "neg", "gauge", "spaced"}
    assert rows["http_total"].value == 1027 and rows["http_total"].labels == {"method": "GET", "code": "200"}
    assert rows["http_total"].ts.timestamp() == 1395066363
    assert rows["plain"].ts.timestamp() == 5000
    assert rows["up"].value == float("inf") and rows["down"].value == float("-inf")
    assert rows["none"].value is None
    assert rows["dup"].labels == {"a": "2"} and rows["neg"].value == -1500 and rows["spaced"].value == 8


def test_exposition_files_with_labels(spark, tmp_path):
    (tmp_path / "a.prom").write_text("x 1\ny{h=\"1\"} 2\n")
    (tmp_path / "b.prom").write_text("x 3\r\n")
    got = prometheus.read_exposition(spark, str(tmp_path), {"env": "t", "h": "9"}).collect()
    assert sorted((r.name, r.value) for r in got) == [("x", 1), ("x", 3), ("y", 2)]
    assert all(r.labels == {"env": "t", "h": "9"} for r in got)
    assert len({r.source for r in got}) == 2


def test_statsd(spark):
    got = statsd.parse_statsd(lines(
        spark, "hits:10|c|@0.5", "temp:21.5|g", "t:320|ms|#host:web-1,zone:a:b,flag", "u:5|s", "h:1|h|@bad",
        "nocolon", "a:1", "b:x|c", "half:4|g|@0.5", "z:4|c|@0", "odd:1|weird|#type:mine", "r:8|c|@0.5|@0.25", " sp :1|c "),
        received=received())
    rows = {r.name: r for r in got.collect()}
    assert set(rows) == {"hits", "temp", "t", "u", "h", "half", "z", "odd", "r", "sp"}
    assert rows["hits"].value == 20 and rows["half"].value == 4 and rows["z"].value == 4 and rows["r"].value == 32
    assert rows["t"].labels == {"type": "timer", "host": "web-1", "zone": "a:b", "flag": "true"}
    assert [rows[n].labels["type"] for n in ("hits", "temp", "u", "h", "odd")] == [
        "counter", "gauge", "set", "histogram", "mine"]
    assert rows["sp"].value == 1


def samples(spark, rows):
    return spark.createDataFrame(rows, "host string, port int, oid string, value double, t long, seq long") \
        .withColumns({"ts": F.timestamp_seconds("t"), "labels": F.create_map(F.lit("site"), F.lit("x"))})


def test_snmp(spark):
    octets, up = "1.3.6.1.2.1.2.2.1.10", "1.3.6.1.2.1.1.3.0"
    df = samples(spark, [("sw", 161, f"{octets}.1", 1000.0, 0, 0), ("sw", 161, f"{octets}.2", 50.0, 0, 1),
                         ("sw", 161, up, 7.0, 0, 2), ("sw", 161, "9.9", 1.0, 0, 3),
                         ("sw", 161, f"{octets}.1", 2000.0, 60, 4), ("sw", 161, f"{octets}.2", 20.0, 60, 5)])
    rows = {r.seq: r for r in snmp.parse_samples(df, bits=32).collect()}
    assert (rows[0].name, rows[0].value, rows[0].unit) == ("ifInOctets", 1000, "bytes")
    assert (rows[4].name, rows[4].value) == ("ifInOctets_delta", 1000)
    assert rows[5].value == 2**32 - 50 + 20
    assert rows[2].name == "sysUpTime" and rows[3].name == "9.9" and rows[3].unit == ""
    assert rows[4].labels == {"site": "x", "host": "sw", "ifIndex": "1"}
    assert rows[4].source == "snmp://sw:161"
    strict = {r.seq: r for r in snmp.parse_samples(df, bits=32, strict_parity=True).collect()}
    assert strict[2].name == up                       # the stored form ends in .0 and is never met
    assert strict[1].value == 2**32 - 1000 + 50       # interfaces overwrite each other


CSV = """name,value,timestamp,host,zone
cpu,50.5,1000,web-01,
cpu,abc,1060,web-01,b
cpu,,1120,web-01,b
mem,70,,web-02,b
mem,71,later,,
mem,nan,1180,web-02,c
"""


def test_csv(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text(CSV)
    got = files.read_metrics(spark, path, labels={"env": "t", "zone": "z"}, received=received())
    assert [f.name for f in got.schema] == [f.name for f in METRIC_SCHEMA]
    rows = got.collect()
    assert [(r.name, r.value, r.ts.timestamp()) for r in rows] == [
        ("cpu", 50.5, 1000), ("mem", 70, 5000), ("mem", 71, 5000), ("mem", None, 1180)]
    assert rows[0].labels == {"env": "t", "zone": "z", "host": "web-01"}
    assert rows[1].labels == {"env": "t", "zone": "b", "host": "web-02"}
    assert rows[0].source.endswith("m.csv")
    assert files.read_csv(spark, path, rejects=True).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, path, value_col="nope")


def test_csv_columns_and_delimiter(spark, tmp_path):
    (tmp_path / "d.csv").write_text("m;v;t\nx;1;10\n")
    r = files.read_csv(spark, str(tmp_path / "d.csv"), "m", "v", "t", ";").first()
    assert (r.name, r.value, r.ts.timestamp(), r.labels) == ("x", 1, 10, {})


ENTRIES = [{"name": "cpu", "value": 1.5, "timestamp": 10, "labels": {"h": "a"}, "unit": "%"}, {"value": 3},
           {"name": "x"}, {"name": "cpu", "value": "2.5"}, {"name": "cpu", "value": "zz"}]


@pytest.mark.parametrize("wrapped", [True, False])
def test_json(spark, tmp_path, wrapped):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"metrics": ENTRIES} if wrapped else ENTRIES))
    rows = files.read_metrics(spark, str(path), labels={"h": "d", "e": "1"}, received=received()).collect()
    assert [(r.name, r.value, r.ts.timestamp(), r.unit) for r in rows] == [("cpu", 1.5, 10, "%"), ("cpu", 2.5, 5000, "")]
    assert rows[0].labels == {"h": "a", "e": "1"} and rows[1].labels == {"h": "d", "e": "1"}


def test_json_lines_and_unknown_format(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("\n".join(json.dumps(e) for e in ENTRIES))
    assert files.read_json(spark, str(path), lines=True).count() == 2
    with pytest.raises(ValueError):
        files.read_metrics(spark, str(tmp_path / "m.xml"))


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    text = lines(spark, json.dumps({"name": "a", "value": 1, "timestamp": 86400}),
                 json.dumps([{"name": "a", "value": 2}, {"name": "", "value": 3}, {"name": "b"}, {"name": "b", "value": 4}]))
    assert store.append(store.parse_payloads(text, received=received()), path) == 3
    assert store.append(store.parse_payloads(text, received=received()), path) == 3
    back = store.read_store(spark, path)
    assert [(r.name, r.points) for r in store.catalog(back).collect()] == [("a", 4), ("b", 2)]
    assert back.filter("day = '1970-01-02'").count() == 2
    assert {r.name for r in store.names(back).collect()} == {"a", "b"}


def test_last_points(series):
    rows = series({"a": np.arange(30.0), "b": [1, 2]})
    got = store.last_points(rows, 5).groupBy("series_id").agg(F.count("*"), F.min("value")).orderBy("series_id").collect()
    assert [tuple(r) for r in got] == [("a", 5, 25), ("b", 2, 1)]
    assert store.last_points(rows, 0).count() == 32
    long = store.last_points(series(np.arange(3000.0)), 1500)
    assert long.count() == 1500 and long.agg(F.min("value")).first()[0] == 1500


def test_serde(spark):
    full = {"name": "a", "value": 1.0, "timestamp": 12.5, "labels": {"k": "v"}, "source": "s", "unit": "u"}
    df = spark.createDataFrame([(json.dumps(full),), (json.dumps({"name": "b", "value": 2}),)], "json string")
    rows = serde.metrics_from_json(df, received=received()).orderBy("name").collect()
    assert (rows[0].ts.timestamp(), rows[0].labels, rows[0].source, rows[0].unit) == (12.5, {"k": "v"}, "s", "u")
    assert (rows[1].ts.timestamp(), rows[1].labels, rows[1].source, rows[1].unit) == (5000, {}, "unknown", "")
    texts = serde.metrics_to_json(serde.metrics_from_json(df.limit(1))).collect()
    assert json.loads(texts[0].json) == full


def fires(spark, rows):
    df = spark.createDataFrame(rows, "metric_name string, labels map<string,string>, t double, seq long, severity int, value double, score double")
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))).drop("t")


def test_outbox(spark):
    alerts = al.episodes(fires(spark, [("cpu", {"h": "a"}, 0.0, 0, 3, 91.23456, 0.75), ("cpu", {"h": "a"}, 90.0, 1, 1, 95.0, 0.4)]))
    box = {r.channel: json.loads(r.payload) for r in ob.outbox(alerts, title="T", slack_channel="#ops", routing_key="k").collect()}
    hook = box["webhook"]
    assert hook["severity"] == "high" and hook["count"] == 2 and hook["labels"] == {"h": "a"} and hook["first_seen"] == 0
    assert box["email"]["subject"] == "[T HIGH] cpu"
    assert "Value: 95.0000\nScore: 0.4000\n" in box["email"]["body"] and "Duration: 1.5 minutes" in box["email"]["body"]
    card = box["slack"]["attachments"][0]
    assert card["color"] == "#ff4500" and card["title"] == "HIGH: cpu" and box["slack"]["channel"] == "#ops"
    assert [f["value"] for f in card["fields"]] == ["95.0000", "0.4000", "1.5m", "2"]
    pager = box["pagerduty"]
    assert pager["event_action"] == "trigger" and pager["payload"]["severity"] == "error" and pager["routing_key"] == "k"
    with pytest.raises(ValueError):
        ob.outbox(alerts, ("fax",))
    sent = []
    ob.on_each_batch(lambda df: sent.append(df.count()), channels=("webhook",))(alerts, 0)
    assert sent == [1]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,value,timestamp,host\nm,1,10,"say ""hi"", ok"\n')
    (tmp_path / "b.csv").write_text("host,name,value,timestamp\nh2,m2,2,20\n")
    rows = {r.name: r for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert {n: (r.value, r.ts.timestamp()) for n, r in rows.items()} == {"m": (1, 10), "m2": (2, 20)}
    assert rows["m"].labels == {"host": 'say "hi", ok'} and rows["m2"].labels == {"host": "h2"}


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,value,host\nm,1,"one\ntwo"\n')
    assert files.read_csv(spark, str(tmp_path / "a.csv"), multiline=True).first().labels == {"host": "one\ntwo"}


def test_json_documents_that_cannot_be_used(spark, tmp_path):
    (tmp_path / "good.json").write_text('\n [{"name": "a", "value": 1}]')
    (tmp_path / "none.json").write_text('{"name": "a", "value": 1}')
    assert files.read_json(spark, str(tmp_path), received=received()).count() == 1
    (tmp_path / "cut.json").write_text('[{"name": "a", "value": 1')
    (tmp_path / "text.json").write_text('"text"')
    bad = files.read_json(spark, str(tmp_path), rejects=True).collect()
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad) == ["cut.json", "text.json"]
    with pytest.raises(Exception, match="cut.json|text.json"):
        files.read_json(spark, str(tmp_path)).count()


def test_payload_values_as_text(spark):
    got = store.parse_payloads(lines(spark, '{"name": "a", "value": "3", "timestamp": "7"}'), received=received()).first()
    assert (got.value, got.ts.timestamp()) == (3.0, 7)


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_json_documents_are_split(spark, tmp_path, block):
    """Wherever the blocks end: strings with brackets, quotes and escapes, nested lists, elements that are no entries."""
    rng = np.random.default_rng(3)
    odd = ["}", "{", '"', "\\", '\\"}', "]", "[{", "é}", "\n", ""]
    full = [{"name": f"m{i}", "value": i, "timestamp": i, "labels": {"t": "".join(rng.choice(odd, 5)), "{": "}"}} for i in range(60)]
    texts = ["[", " 1, \"}\", [[{\"name\": \"no\", \"value\": 1}], {}], null"]
    for i, e in enumerate(full):
        texts.append(", " + json.dumps(e, indent=i % 3 or None, ensure_ascii=i % 2 == 0))
        if i % 7 == 0:
            texts.append(", {}, true, [\"]\", {\"name\": \"x\", \"value\": 2}]")
    (tmp_path / "a.json").write_text("".join(texts) + ", [{}], 3 ]\n", newline="")
    (tmp_path / "b.json").write_text("\n[]")
    (tmp_path / "c.json").write_text('[{"name": "c", "value": 1}]')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = files.read_json(spark, str(tmp_path), split=True, received=received()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.name, r.value, r.labels.get("t")) for r in rows) == sorted(
        [(e["name"], float(e["value"]), e["labels"]["t"]) for e in full] + [("c", 1.0, None)], key=str)


def test_json_blocks_are_cut_by_records(spark, tmp_path, monkeypatch):
    """What Spark reads at once is cut again, anywhere, and dealt to as many tasks as the text has pieces."""
    monkeypatch.setattr(documents, "BLOCK_RECORDS", 3)
    monkeypatch.setattr(documents, "TASK_BYTES", 200)
    text = "[" + ", ".join(json.dumps({"name": f"m{i}", "value": i, "labels": {"t": 'a } "]" {'}}) for i in range(40)) + "]"
    (tmp_path / "a.json").write_text(text)
    rows = files.read_json(spark, str(tmp_path), split=True, received=received())
    assert sorted((r.value, r.name, r.labels["t"]) for r in rows.collect()) == [(i, f"m{i}", 'a } "]" {') for i in range(40)]
    tasks = documents._tasks(spark, str(tmp_path))
    assert tasks == -(-len(text) // 200) and rows.rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("text", ['{"metrics": []}', '[{"name": "a", "value": 1}', '[{"name": "a", "value": 1}]}', '[{"name": "a}]',
                                  '[{"name": "a", "value": 1} {"name": "b"}]', '[{"name": "a", "value": 1}][{"name": "b"}]'])
def test_split_json_that_is_no_array(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json: not a"):
        files.read_json(spark, str(tmp_path), split=True).collect()
