"""Severity, context, correlation, forecasts, alerts, maintenance, and the detection job."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import TINY, column
from pulsegrid.functions import scalar as sc
from pulsegrid.functions.labels import alert_fingerprint
from pulsegrid.operators import alerts as al, context as cx, forecast as fc, maintenance as mt
from pulsegrid.operators.detectors.statistical import Iqr, ZScore
from pulsegrid.plans import detection as dt
from pulsegrid.plans.preprocess import PreprocessConfig
from test_sources import fires


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize("score,minutes,kind,linked,expected", [
    (.95, 0, "", False, 4), (.75, 0, "", False, 3), (.55, 0, "", False, 2), (.35, 0, "", False, 1), (.1, 0, "", False, 0),
    (.55, 31, "", False, 3), (.95, 31, "", True, 4), (.55, 11, "", False, 3), (.75, 11, "", False, 3),
    (.55, 0, "Error_Rate", False, 3), (.75, 0, "oom", False, 3), (.55, 0, "my_oom", False, 2),
    (.55, 0, "", True, 3), (.1, 31, "disk_full", True, 3)])
def test_severity(spark, score, minutes, kind, linked, expected):
    got = one(spark, sc.severity(F.lit(score), F.lit(float(minutes)), F.lit(kind), F.lit(linked)))
    assert got == expected


def test_severity_names(spark):
    assert [one(spark, sc.severity_label(F.lit(i))) for i in range(5)] == sc.SEVERITIES
    assert one(spark, sc.severity_emoji(F.lit(4))) == "🚨" and one(spark, sc.severity_emoji(F.lit(9))) == "❓"


@pytest.mark.parametrize("when,expected", [
    ("2024-01-16 10:00:00", 1.0), ("2024-01-16 18:00:00", 1.5), ("2024-01-16 03:00:00", 2.0),
    ("2024-01-16 07:59:59", 1.5), ("2024-01-20 10:00:00", 2.0)])
def test_threshold_multiplier(spark, when, expected):
    assert one(spark, sc.threshold_multiplier(F.lit(when).cast("timestamp"))) == expected


def test_context_in_other_zone_and_schedule(spark):
    t = F.lit("2024-01-16 01:00:00").cast("timestamp")
    assert one(spark, sc.threshold_multiplier(t, zone="Asia/Tokyo")) == 1.0
    assert one(spark, sc.threshold_multiplier(t, schedule={"night": 5.0})) == 5.0


def test_messages_round_like_stored_numbers(spark):
    text = one(spark, sc.alert_message(F.lit("m"), F.lit(1234.005), F.lit(0.015)))
    assert text == f"Anomaly detected on m: value={1234.005:.2f}, score={0.015:.2f}"


def anomalies(spark, times):
    rows = [(m, float(t)) for m, ts in times.items() for t in ts]
    return spark.createDataFrame(rows, "series_id string, t double").withColumn("ts", F.timestamp_seconds("t"))


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.metric)
        assert r["size"] >= 1
    return sorted(map(sorted, out.values()))


def test_correlation(spark):
    close = {"cpu": [1000], "memory": [1030], "disk": [9000]}
    assert groups(cx.correlated_metrics(anomalies(spark, close), 60)) == [["cpu", "memory"]]
    edge = {"a": [0], "b": [60], "c": [121]}
    assert groups(cx.correlated_metrics(anomalies(spark, edge), 60)) == [["a", "b"]]
    assert groups(cx.correlated_metrics(anomalies(spark, {"only": [1, 2]}), 60)) == [["only"]]
    assert groups(cx.correlated_metrics(anomalies(spark, {"a": [0], "b": [900]}), 60)) == []


def brute_groups(times, w):
    names = list(times)
    left = {m: {m} for m in names}
    for a in names:
        for b in names:
            if any(abs(x - y) <= w for x in times[a] for y in times[b]):
                merged = left[a] | left[b]
                for m in merged:
                    left[m] = merged
    return sorted(sorted(g) for g in {frozenset(g) for g in left.values()} if len(g) > 1)


def test_correlation_equals_brute_force_on_chains(spark):
    rng = np.random.default_rng(4)
    times = {f"m{i:02d}": sorted(rng.integers(0, 60_000, 4).tolist()) for i in range(25)}
    times |= {f"chain{i}": [100_000 + 50 * i, 200_000 + 900 * i] for i in range(8)}
    got = groups(cx.correlated_metrics(anomalies(spark, times), 120, TINY))
    assert got == brute_groups(times, 120)


# --- forecasts ---------------------------------------------------------------

def test_forecast_terms(series):
    rng = np.random.default_rng(42)
    v = np.linspace(10, 80, 200) + rng.normal(0, 1, 200)
    points, summary = fc.forecast(series(v), horizon=30, capacity_threshold=100.0, sla_threshold=84.0, layout=TINY)
    x = np.arange(200)
    slope, icept = np.polyfit(x, v, 1)
    sd = (v - slope * x - icept).std()
    fx = 200 + np.arange(30)
    width = 1.959963984540054 * sd * np.sqrt(1 + 1 / 200 + (fx - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    mean = column(points, "predicted", ("step",))
    np.testing.assert_allclose(column(points, "upper", ("step",)) - mean, width, rtol=1e-9)
    np.testing.assert_allclose(mean, slope * fx + icept, atol=2.0)       # plus a small season
    s = summary.first()
    ahead = (100 - (slope * 200 + icept)) / slope * 60
    assert s.days_to_exhaustion == pytest.approx(ahead / 86400) and s.trend_slope == pytest.approx(slope / 60)
    assert s.exhaustion_ts.timestamp() == pytest.approx(199 * 60 + ahead, abs=1e-3)
    want = max(0.5 * math.erfc((84 - m) / (w / 1.959963984540054) / math.sqrt(2)) for m, w in zip(mean[:24], width))
    assert s.sla_risk_score == pytest.approx(want, rel=1e-9)
    assert points.orderBy("step").first().ts.timestamp() == 200 * 60


def test_forecast_with_season_and_missing(series, seasonal_values):
    v = seasonal_values.copy()
    v[[5, 50, 51]] = np.nan
    clean = v[~np.isnan(v)]
    from test_preprocess import brute_period, decomposed
    period = max(2, brute_period(clean))
    seasonal = decomposed(clean, period)[1]
    n = len(clean)
    slope, icept = np.polyfit(np.arange(n), clean, 1)
    want = [slope * (n + i) + icept + seasonal[(n + i) % period] for i in range(10)]
    points, _ = fc.forecast(series(v), horizon=10, layout=TINY)
    np.testing.assert_allclose(column(points, "predicted", ("step",)), want, atol=1e-8)


def test_short_and_falling_series(series):
    rows = series({"two": [1, 2], "gaps": [1, None, None, 2], "down": np.arange(20, 0, -1.0)})
    points, summary = fc.forecast(rows, horizon=2, capacity_threshold=50.0)
    assert {r.series_id for r in points.select("series_id").distinct().collect()} == {"down"}
    assert summary.first().days_to_exhaustion is None
    t = {r.series_id: r for r in fc.trend_summary(rows).collect()}
    assert t["two"].status == t["gaps"].status == "insufficient_data" and t["two"].direction is None
    assert t["down"].direction == "decreasing" and t["down"].r_squared == pytest.approx(1) and t["down"].significant


def test_trend_p_value(series):
    rng = np.random.default_rng(1)
    v = rng.normal(size=12) + 0.1 * np.arange(12)
    r = fc.trend_summary(series(v)).first()
    corr = np.corrcoef(np.arange(12), v)[0, 1]
    t = abs(corr) * math.sqrt(10 / (1 - corr * corr))
    grid = np.linspace(t, t + 400, 2_000_001)
    density = math.gamma(5.5) / (math.sqrt(10 * math.pi) * math.gamma(5)) * (1 + grid * grid / 10) ** -5.5
    assert r.p_value == pytest.approx(2 * np.trapezoid(density, grid), rel=1e-4)
    assert r.slope == pytest.approx(np.polyfit(np.arange(12), v, 1)[0]) and r.current_value == v[-1]
    flat = fc.trend_summary(series([2, 2, 2, 2])).first()
    assert flat.direction == "stable" and flat.p_value == 1.0 and not flat.significant


# --- alerts ------------------------------------------------------------------

def by_first(df):
    return df.orderBy("first_seen").collect()


def test_dedup_window_slides_and_is_strict(spark):
    rows = [("cpu", {}, t, i, s, float(i), 0.5) for i, (t, s) in enumerate(
        [(0.0, 2), (299.0, 1), (598.9, 3), (898.9, 0)])]
    got = by_first(al.episodes(fires(spark, rows), layout=TINY))
    assert [(a["count"], a.severity, a.value, a.is_current) for a in got] == [(3, 3, 2.0, False), (1, 0, 3.0, True)]
    assert got[0].message == "Anomaly detected on cpu: value=0.00, score=0.50"
    assert got[0].id.endswith("-0") and got[1].id.endswith("-898")
    assert got[0].duration_minutes == pytest.approx(598.9 / 60)


def test_labels_tell_alerts_apart(spark):
    rows = [("cpu", {"h": "a"}, 0.0, 0, 1, 1.0, .5), ("cpu", {"h": "b"}, 1.0, 1, 1, 1.0, .5), ("cpu", {"h": "a"}, 2.0, 2, 1, 1.0, .5)]
    assert sorted(a["count"] for a in al.episodes(fires(spark, rows)).collect()) == [1, 2]


def told(spark, fp_of, rows):
    df = spark.createDataFrame(rows, "name string, t double, seq long, action string")
    fp = alert_fingerprint(F.col("name"), F.create_map().cast("map<string,string>"))
    return df.select(fp.alias("fingerprint"), F.timestamp_seconds("t").alias("ts"), "seq", "action")


def quiet(spark, rows):
    df = spark.createDataFrame(rows, "name string, t double, minutes double")
    fp = alert_fingerprint(F.col("name"), F.create_map().cast("map<string,string>"))
    return df.select(fp.alias("fingerprint"), F.timestamp_seconds("t").alias("start_ts"), "minutes")


def test_commands(spark):
    f = fires(spark, [("cpu", {}, 0.0, 0, 1, 1.0, .5), ("cpu", {}, 100.0, 1, 1, 2.0, .5), ("cpu", {}, 250.0, 2, 1, 3.0, .5),
                      ("mem", {}, 0.0, 3, 1, 1.0, .5)])
    c = told(spark, None, [("cpu", 200.0, 9, "resolve"), ("mem", 50.0, 9, "acknowledge"), ("none", 5.0, 9, "resolve"),
                           ("cpu", 220.0, 10, "acknowledge")])
    got = al.episodes(f, commands=c)
    cpu = by_first(got.filter("metric_name = 'cpu'"))
    assert [(a.state, a["count"]) for a in cpu] == [("resolved", 2), ("firing", 1)]     # a resolve ends the run
    assert cpu[0].last_seen.timestamp() == 200
    assert by_first(got.filter("metric_name = 'mem'"))[0].state == "acknowledged"
    assert al.active_alerts(got).count() == 2 and al.history(got).count() == 1 and al.open_alerts(got).count() == 2


def test_silences(spark):
    f = fires(spark, [("cpu", {}, 0.0, 0, 1, 1.0, .5), ("cpu", {}, 120.0, 1, 4, 9.0, .9), ("cpu", {}, 700.0, 2, 1, 2.0, .5)])
    s = quiet(spark, [("cpu", 60.0, 10.0)])                       # until 660
    got = by_first(al.episodes(f, silences=s))
    assert [(a.state, a["count"], a.severity, a.value) for a in got] == [("silenced", 1, 1, 1.0), ("firing", 1, 1, 2.0)]
    assert al.silenced(al.with_fingerprint(f), s).count() == 1
    assert al.not_silenced(al.with_fingerprint(f), s).count() == 2
    shorter = quiet(spark, [("cpu", 60.0, 60.0), ("cpu", 100.0, 0.1)])      # the later one replaces the first
    assert al.silenced(al.with_fingerprint(f), shorter).count() == 0


def test_silences_on_a_timeline(spark):
    """Many silences of one fingerprint, equal starts, ends and fires on one instant, rows without a time or fingerprint."""
    rng = np.random.default_rng(3)
    given = [(str(rng.choice(["a", "b"])), float(t), float(rng.choice([1, 30, 90, -3]))) for t in rng.choice(np.arange(0, 200_000, 60), 80, replace=False)]
    given += [("a", None, 5.0), (None, 60.0, 5.0), ("b", 300_000.0, None)]
    fired = [(str(rng.choice(["a", "b", "c"])), float(rng.integers(0, 4000)) * 60) for _ in range(300)] + [("a", None), (None, 120.0), ("b", 300_060.0)]
    fired += fired[:20]
    s = spark.createDataFrame(given, "fingerprint string, t double, minutes double").select("fingerprint", F.timestamp_seconds("t").alias("start_ts"), "minutes")
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(fired)], "seq long, fingerprint string, t double").select(
        "*", F.timestamp_seconds("t").alias("ts"), F.create_map(F.lit("span"), F.lit("x")).alias("labels"), F.lit(1).alias("cell"))

    def muted(name, t):
        began = [x for x in given if x[0] == name and name is not None and t is not None and x[1] is not None and x[1] <= t]
        last = max(began, key=lambda x: x[1], default=None)
        return last is not None and last[2] is not None and t < last[1] + last[2] * 60

    want = [i for i, x in enumerate(fired) if muted(*x)]
    assert 20 < len(want) < 250
    for got, ids_ in ((al.silenced(f, s), want), (al.not_silenced(f, s), [i for i in range(len(fired)) if i not in want])):
        assert got.columns == f.columns and sorted(r.seq for r in got.collect()) == ids_
        # no join by fingerprint in which every fire meets every silence
        assert not any("Join" in line and ">=" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_escalation(spark):
    f = fires(spark, [("a", {}, 0.0, 0, 1, 1.0, .5), ("b", {}, 0.0, 1, 3, 1.0, .5), ("c", {}, 5000.0, 2, 0, 1.0, .5)])
    ticks = spark.createDataFrame([(t,) for t in (60.0, 1800.0, 1801.0, 4000.0)], "t double").select(F.timestamp_seconds("t").alias("ts"))
    got = {r.metric_name: r.severity for r in al.escalate(al.episodes(f), ticks).collect()}
    assert got == {"a": 3, "b": 4, "c": 0}


# --- maintenance ---------------------------------------------------------------

@pytest.fixture
def win(spark):
    rows = [("w1", "all", 0, 3600, []), ("w2", "cpu", 7200, 10800, ["cpu"]), ("w3", "host", 7200, 200_000, ["web-0"]),
            ("w4", "star", 300_000, 300_060, ["*"])]
    df = spark.createDataFrame(rows, "id string, name string, s long, e long, targets array<string>")
    return df.select("id", "name", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"),
                     "targets", F.lit(True).alias("recalibrate"), F.lit("me").alias("created_by"))


def points(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, t double, labels map<string,string>")
    return df.withColumns({"ts": F.timestamp_seconds("t"), "seq": F.monotonically_increasing_id(), "value": F.col("t")})


def test_suppression(spark, win):
    rows = points(spark, [("cpu_usage", 10.0, {}), ("cpu_usage", 3600.0, {}), ("cpu_usage", 3601.0, {}), ("cpu_usage", 9000.0, {}),
                          ("disk", 9000.0, {}), ("disk", 150_000.0, {"host": "web-01"}), ("disk", 150_000.0, {"host": "db"}),
                          ("disk", 300_030.0, None)])
    gone = {(r.series_id, r.t, (r.labels or {}).get("host")) for r in mt.suppressed(rows, win, labels="labels").collect()}
    assert gone == {("cpu_usage", 10.0, None), ("cpu_usage", 3600.0, None), ("cpu_usage", 9000.0, None),
                    ("disk", 150_000.0, "web-01"), ("disk", 300_030.0, None)}
    assert mt.not_suppressed(rows, win, labels="labels").count() == 3
    assert mt.not_suppressed(rows, win).count() == 4              # labels not looked at


def test_many_targets_equal_plain_matching(spark):
    """Targets of several lengths, shared, repeated, NULL, empty and missing; rows that repeat, without a name, time or labels."""
    rng = np.random.default_rng(5)
    names, hosts = ["cpu_usage", "cpu", "disk_é", "", None], ["web-01", "web-012", "db", "é", None]
    rows = [(names[rng.integers(5)], None if rng.random() < .05 else float(rng.integers(0, 200_000)),
             None if rng.random() < .2 else {"host": hosts[rng.integers(5)], "zone": hosts[rng.integers(5)]}) for _ in range(150)]
    rows += rows[:20]
    pool = ["cpu", "cpu_usage", "web-01", "b", "é", "", "*", "absent", None]
    windows = []
    for i in range(60):
        s, long = int(rng.integers(0, 200_000)), int(rng.choice([0, 600, 90_000, -5]))
        targets = None if i % 20 == 0 else [] if i % 20 == 1 else [pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 4))]
        windows.append((f"w{i}", s, s + long, targets))

    def hit(row, w):
        name, t, tags = row
        texts = [x for x in (name, *(tags or {}).values()) if x is not None]
        return t is not None and w[1] <= t <= w[2] and (
            not w[3] or any(g == "*" or (g is not None and any(g in x for x in texts)) for g in w[3]))

    win = spark.createDataFrame(windows, "id string, s long, e long, targets array<string>").select(
        "id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"), "targets")
    data = points(spark, rows)
    key = lambda r: (r[0], r[1], sorted((r[2] or {}).items(), key=str))
    back = lambda df: sorted((key((r.series_id, r.t, r.labels)) for r in df.collect()), key=str)
    inside = [any(hit(r, w) for w in windows) for r in rows]
    assert 20 < sum(inside) < len(rows) - 10
    assert back(mt.suppressed(data, win, labels="labels")) == sorted((key(r) for r, i in zip(rows, inside) if i), key=str)
    assert back(mt.not_suppressed(data, win, labels="labels")) == sorted((key(r) for r, i in zip(rows, inside) if not i), key=str)
    pairs = mt.suppressing(data, win, labels="labels")
    assert pairs.columns == data.columns + ["window_id", "start_ts", "end_ts", "targets"]
    got = sorted((str((key((r.series_id, r.t, r.labels)), r.window_id)) for r in pairs.collect()))
    assert got == sorted(str((key(r), w[0])) for r in rows for w in windows if hit(r, w))


def at(sec):
    return F.timestamp_seconds(F.lit(sec))


def ids(df):
    return [r.id for r in df.collect()]


def test_window_lists(spark, win):
    assert ids(mt.active_windows(win, at(7300))) == ["w2", "w3"]
    assert ids(mt.list_windows(win, at(11_000))) == ["w3", "w4"]
    assert ids(mt.list_windows(win, at(11_000), include_past=True)) == ["w1", "w2", "w3", "w4"]
    assert ids(mt.window_by_id(win, "w2")) == ["w2"]
    assert ids(mt.recalibration_due(win, at(11_000))) == ["w1"]
    assert ids(mt.recalibration_due(win, at(11_700)).orderBy("id")) == ["w1", "w2"]
    assert ids(mt.recalibration_due(win, at(11_700), win.filter("id = 'w1'"))) == ["w2"]
    assert ids(mt.expired(win, at(97_300))) == ["w1", "w2"]
    assert sorted(ids(mt.keep_unexpired(win, at(97_300)))) == ["w3", "w4"]


def test_refit_rows(spark, win):
    rows = points(spark, [("cpu", 100.0, {}), ("cpu", 4000.0, {}), ("cpu", 4600.0, {}), ("mem", 9_000_000.0, {})])
    got = mt.rows_after_maintenance(rows, win.filter("id = 'w1'")).collect()
    assert [(r.series_id, r.t) for r in got] == [("cpu", 4600.0)]


def test_window_changes(spark, win):
    log = spark.createDataFrame([(1000, 1, "put", "n1"), (1001, 1, "delete", "w1"), (1002, 1, "put", "n2"), (1003, 1, "delete", "n2")],
                                "t long, seq long, action string, id string")
    log = log.withColumns({"ts": F.timestamp_seconds("t"), "name": F.lit(None).cast("string"),
                           "start_ts": F.lit(None).cast("timestamp"), "end_ts": F.lit(None).cast("timestamp"),
                           "targets": F.lit(None).cast("array<string>"), "recalibrate": F.lit(None).cast("boolean"),
                           "created_by": F.lit(None).cast("string")}).drop("t")
    rows = {r.id: r for r in mt.apply_changes(win, log).collect()}
    assert set(rows) == {"n1", "w2", "w3", "w4"}
    assert rows["n1"].name == "Maintenance" and rows["n1"].end_ts.timestamp() == 4600 and rows["n1"].recalibrate


def test_health(spark, win):
    f = fires(spark, [("a", {}, 0.0, 0, 1, 1.0, .5), ("b", {}, 0.0, 1, 3, 1.0, .5)])
    assert tuple(al.health(al.episodes(f), mt.active_windows(win, at(10))).first()) == (2, 1)


# --- the detection job ---------------------------------------------------------

def test_detection(series, spiky):
    rows = series({"cpu": spiky, "oom": spiky, "flat": np.full(50, 3.0), "few": [1, 2, 999]})
    cfg = dt.DetectionConfig(preprocess=PreprocessConfig(handle_outliers=False), strategy="any", min_points=10)
    found = dt.detect(rows, cfg, TINY)
    got = found.collect()
    assert {r.seq for r in got if r.series_id == "cpu"} >= {100, 200, 300, 400}
    assert {r.series_id for r in got} == {"cpu", "oom"}
    assert all(r.raw == r.value and set(r.detectors) <= {"zscore", "iqr"} and r.detectors for r in got)
    sev = {(r.series_id, r.seq): r.severity for r in got}
    assert all(sev["oom", s] >= sev["cpu", s] for s in (100, 200, 300, 400))
    summary = {r.series_id: r for r in dt.detection_summary(rows, found).collect()}
    assert summary["flat"].anomaly_count == 0 and summary["flat"].max_severity == "info"
    assert summary["cpu"].total_points == 500


def test_default_cleaning_hides_spikes(series, spiky):
    assert dt.detect(series(spiky)).filter("seq in (100, 200, 300, 400)").count() == 0


def test_context_suppression(series, spiky):
    quiet_ = dt.detect(series(spiky), dt.DetectionConfig(preprocess=None, use_context=True, schedule={"night": 9.0, "after_hours": 9.0}))
    loud = dt.detect(series(spiky), dt.DetectionConfig(preprocess=None))
    assert quiet_.count() < loud.count()


def test_methods_and_grading(series, spiky):
    for method in ("zscore", "iqr", "gesd"):
        assert dt.detect(series(spiky), dt.DetectionConfig(detectors=dt.by_method(method), preprocess=None)).count() >= 4
    with pytest.raises(ValueError):
        dt.by_method("magic")
    found = dt.detect(series(spiky), dt.DetectionConfig(preprocess=None))
    spark = found.sparkSession
    longer = dt.regrade(found, spark.createDataFrame([("s", 45.0)], "series_id string, duration_minutes double"),
                        spark.createDataFrame([("s",)], "metric string"))
    before = {r.seq: r.severity for r in found.collect()}
    assert all(r.severity == min(4, before[r.seq] + 2) for r in longer.collect())


def test_alerts_from_anomalies(spark, series, spiky, win):
    found = dt.detect(series({"cpu": spiky}), dt.DetectionConfig(preprocess=None))
    all_, fewer = dt.alerts_for(found).count(), dt.alerts_for(found, win.filter("id = 'w1'").withColumn("end_ts", at(6500))).count()
    assert 0 < fewer < all_


def test_hours_do_not_follow_the_session_zone(spark):
    from pulsegrid.functions.scalar import iso_time, temporal_context

    rows = spark.sql("select timestamp'2024-01-15 12:00:00Z' ts union all select timestamp'2024-07-15 23:30:00Z'").cache()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(r) for z in ("UTC", "Europe/Berlin") for r in rows.orderBy("ts").select(
            temporal_context(F.col("ts"), zone=z)["hour"], temporal_context(F.col("ts"), zone=z)["day_of_week"],
            iso_time(F.col("ts"), z)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(12, 0, "2024-01-15T12:00:00"), (23, 0, "2024-07-15T23:30:00"),
                   (13, 0, "2024-01-15T13:00:00"), (1, 1, "2024-07-16T01:30:00")]


def test_windows_of_years_make_two_buckets(spark):
    from pulsegrid.operators import maintenance as mt

    w = spark.sql("""select 'w' id, timestamp'1970-01-01 00:00:00Z' start_ts, timestamp'2023-01-01 00:00:00Z' end_ts, array('s') targets
                     union all select 'v', timestamp'1970-01-01 00:10:00Z', timestamp'1970-01-01 00:20:00Z', array('*')""")
    assert mt._bucketed(w).count() <= 4
    rows = spark.range(100).select(F.lit("s").alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"))
    assert (mt.suppressed(rows, w).count(), mt.not_suppressed(rows, w).count(), mt.suppressing(rows, w).count()) == (100, 0, 111)
    assert mt.not_suppressed(rows, w.filter("false")).count() == 100 and mt.suppressed(rows, w.filter("false")).isEmpty()


def test_rows_are_not_paired_with_every_window_that_covers_them(spark, monkeypatch):
    """Whether a row is covered, and until when, needs no pairs; a target that holds another of its window makes none."""
    rows = spark.range(50).select(F.lit("cpu").alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"))
    w = spark.range(200).select(
        F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") % 7 * 60).alias("start_ts"),
        F.timestamp_seconds(F.lit(1200) + F.col("id") % 11).alias("end_ts"), F.array(F.lit("cpu"), F.lit("pu"), F.lit("other")).alias("targets"))
    by_target = mt._by_target(mt._bucketed(w))
    assert {(r._target, *r._earlier) for r in by_target.collect()} == {("pu",), ("other", "pu")}
    size = F.lit(3600.0) * F.pow(F.lit(4.0), F.col("_level"))
    long = F.unix_seconds("end_ts") - F.unix_seconds("start_ts")
    assert by_target.filter((F.col("_level") > 0) & (size > long * 1.001)).isEmpty()
    pairs = mt.suppressing(rows, w)
    inside = sum(i % 7 * 60 <= t <= 1200 + i % 11 for i in range(200) for t in range(0, 3000, 60))
    assert pairs.count() == pairs.select("seq", "window_id").distinct().count() == inside
    monkeypatch.setattr(mt, "_pairs", None)
    assert (mt.suppressed(rows, w).count(), mt.not_suppressed(rows, w).count()) == (21, 29)
    assert {r.seq for r in mt.rows_after_maintenance(rows, w).collect()} == set(range(36, 50))
