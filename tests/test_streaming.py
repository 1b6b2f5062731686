"""Streams over several micro-batches give what one batch job gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import column
from pulsegrid.functions.labels import alert_fingerprint
from pulsegrid.operators import alerts as al, maintenance as mt
from pulsegrid.operators.detectors.statistical import SlidingZScore, ZScore
from pulsegrid.sources import snmp
from pulsegrid.streaming import alerts as sa, metrics as sm, runs
from workload.tables import in_turn


@pytest.fixture
def streamed(spark, tmp_path):
    """Write parts of a table as files in time order, and read them as a stream of one file per batch."""
    count = [0]

    def make(df, parts=4):
        count[0] += 1
        path = str(tmp_path / f"stream{count[0]}")
        lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        step = (hi - lo) // parts + 1
        for i in range(parts):
            part = df.filter(((F.unix_micros("ts") - lo) / step).cast("int") == i)
            part.coalesce(1).write.mode("append").parquet(path)
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return runs.stream_parquet(spark, path, ddl, files_per_batch=1)
    return make


@pytest.fixture
def rows(series, spiky):
    return series({"a": spiky, "b": spiky[::-1]})


@pytest.fixture
def later(rows):
    """The same rows not at the epoch: that is where watermarks start, and rows there count as late."""
    return rows.withColumn("ts", F.col("ts") + F.expr("interval 10 days"))


def test_closed_streams_return_all_bins(rows, streamed):
    got = runs.run_closed(streamed(rows), lambda r: sm.resample_stream(r, "10 minutes", "5 minutes", "max"))
    want = rows.groupBy("series_id", F.window("ts", "10 minutes").alias("w")).agg(F.max("value").alias("v"))
    assert sorted(map(tuple, got.select("series_id", "bin_start", "value").collect())) == sorted(
        map(tuple, want.select("series_id", "w.start", "v").collect()))
    spans = runs.run_closed(streamed(rows), lambda r: sm.sliding_stats(r, "30 minutes", "10 minutes", "5 minutes"))
    want = rows.groupBy("series_id", F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(F.count("value").alias("n"))
    assert sorted(map(tuple, spans.select("series_id", "span_start", "n").collect())) == sorted(
        map(tuple, want.select("series_id", "w.start", "n").collect()))


def test_resample_closes_bins_behind_the_watermark(rows, streamed):
    got = runs.run_available(sm.resample_stream(streamed(rows), "10 minutes", "5 minutes", "max"))
    want = rows.groupBy("series_id", F.window("ts", "10 minutes").alias("w")).agg(F.max("value").alias("v"))
    closed = want.filter("w.end <= timestamp_seconds(499 * 60 - 300)")
    assert got.count() == closed.count() > 90
    key = [F.col("series_id"), F.col("bin_start")]
    both = got.join(closed.select("series_id", F.col("w.start").alias("bin_start"), "v"), ["series_id", "bin_start"])
    assert both.filter("value <> v").count() == 0 and both.count() == got.count()
    with pytest.raises(ValueError):
        sm.resample_stream(rows, "1 hour", "1 hour", "mode")


def test_sliding_stats(rows, streamed):
    got = runs.run_available(sm.sliding_stats(streamed(rows), "1 hour", "30 minutes", "5 minutes"))
    first = got.filter("series_id = 'a' and span_start = timestamp_seconds(0)").first()
    v = column(rows.filter("series_id = 'a'"))[:60]
    assert first.n == 60 and first["mean"] == pytest.approx(v.mean()) and first.sd == pytest.approx(v.std())


def test_sliding_scores_do_not_depend_on_batches(later, streamed):
    rows = later
    got = runs.run_closed(streamed(rows), lambda r: sm.sliding_scores(r, 30, "1 hour"))
    want = SlidingZScore(30).fit_detect(rows)
    np.testing.assert_allclose(column(got, "score"), column(want, "score"), atol=1e-6)


def test_scoring_and_suppression(spark, rows, streamed):
    z = ZScore()
    got = runs.run_available(sm.score_stream(streamed(rows), z, z.fit(rows)))
    np.testing.assert_allclose(column(got, "score"), column(z.fit_detect(rows), "score"))
    windows = spark.createDataFrame([("w", 600, 1200, ["a"])], "id string, s long, e long, targets array<string>").select(
        "id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"), "targets")
    kept = runs.run_available(sm.suppress_stream(streamed(rows), windows))
    assert kept.count() == 1000 - 11
    seen = []
    each = sm.suppress_each_batch(lambda: windows, lambda df, i: seen.append(df.count()))
    runs.run_each_batch(streamed(rows), each)
    assert sum(seen) == 1000 - 11 and len(seen) == 4


def test_statsd_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"hits:{i + 1}|c|@0.5\nbad line\n")
    got = runs.run_available(sm.statsd_intake(runs.stream_text(spark, str(tmp_path / "in"), 1)))
    assert sorted(r.value for r in got.collect()) == [2, 4, 6]


def test_counters_across_batches(spark, frame, streamed):
    octets = "1.3.6.1.2.1.2.2.1.10"
    pdf = pd.DataFrame([(f"h{i % 2}", 161, f"{octets}.{i % 3}", float((i * 997_000_003) % 2**32), 1e6 + i * 30, i) for i in range(120)],
                       columns=["host", "port", "oid", "value", "t", "seq"])
    df = frame(pdf).withColumns({"ts": F.timestamp_seconds("t"), "port": F.col("port").cast("int"),
                                 "labels": F.create_map(F.lit("x"), F.lit("y"))}).drop("t")
    for strict in (False, True):
        got = runs.run_closed(streamed(df), lambda r: sm.counter_stream(r, "1 hour", 32, strict))
        want = snmp.parse_samples(df, bits=32, strict_parity=strict)
        assert column(got, "value", ("seq",)).tolist() == column(want, "value", ("seq",)).tolist()
        assert [r.name for r in got.orderBy("seq").collect()] == [r.name for r in want.orderBy("seq").collect()]
        assert got.first().labels["x"] == "y"


FP = alert_fingerprint


@pytest.fixture
def history(spark, frame):
    """Random fires, silences, acknowledgements and resolutions of a few metrics."""
    rng = np.random.default_rng(11)
    at = np.sort(rng.uniform(0, 40_000, 400)).round(3)
    pdf = pd.DataFrame({
        "metric_name": rng.choice(["cpu", "mem", "disk"], 400), "t": at, "seq": np.arange(400),
        "kind": rng.choice(["fire", "acknowledge", "resolve", "silence"], 400, p=[.85, .06, .06, .03]),
        "severity": rng.integers(0, 5, 400), "value": rng.uniform(0, 100, 400).round(2), "score": rng.uniform(0, 1, 400).round(3),
        "minutes": rng.choice([1.0, 10.0, 30.0], 400)})
    none = F.create_map().cast("map<string,string>")
    df = frame(pdf).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))).drop("t")
    return df.withColumns({"labels": none, "severity": F.col("severity").cast("int")}).withColumn(
        "fingerprint", FP(F.col("metric_name"), F.col("labels")))


def as_set(df):
    cols = ["id", "metric_name", "severity", "state", "first_seen", "last_seen", "count", "value", "score", "message"]
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("parts", [1, 5])
def test_alert_states_equal_batch_episodes(history, streamed, parts):
    fires = history.filter("kind = 'fire'")
    commands = history.filter("kind in ('acknowledge', 'resolve')").select("fingerprint", "ts", "seq", F.col("kind").alias("action"))
    silences = history.filter("kind = 'silence'").select("fingerprint", F.col("ts").alias("start_ts"), "minutes")
    want = al.episodes(fires.drop("kind", "minutes"), silences=silences, commands=commands)
    given = history.select(*sa.EVENT_COLUMNS)
    rules = sa.AlertRules(escalation_minutes=1e9)
    got = sa.latest_alerts(runs.run_closed(streamed(given, parts), lambda e: sa.alert_stream(e, "1 second", rules)))
    assert as_set(got) == as_set(want)


def test_escalation_and_forgetting_follow_event_time(spark, frame, streamed):
    pdf = pd.DataFrame([("x", 0.0, 0, "fire", 1), ("x", 100.0, 1, "fire", 1), ("y", 0.0, 2, "fire", 1), ("y", 60.0, 3, "acknowledge", 0),
                        ("z", 90_000.0, 4, "fire", 0), ("x", 180_000.0, 5, "acknowledge", 0)],
                       columns=["metric_name", "t", "seq", "kind", "severity"])
    # not at the epoch: that is where watermarks start, and rows there count as late
    df = frame(pdf).withColumns({"ts": F.timestamp_seconds(F.col("t") + 1e6), "fingerprint": F.col("metric_name"), "value": F.lit(1.0),
                                 "score": F.lit(.5), "minutes": F.lit(None).cast("double"), "severity": F.col("severity").cast("int")})
    rules = sa.AlertRules(keep_open=False)
    changes = runs.run_closed(streamed(df.select(*sa.EVENT_COLUMNS), 3), lambda e: sa.alert_stream(e, "1 minute", rules))
    got = [(r.fingerprint, r.change, r.severity) for r in changes.orderBy("fingerprint", "ts", "seq").collect()]
    assert got[:3] == [("x", "fired", 1), ("x", "merged", 1), ("x", "escalated", 2)]
    assert ("y", "escalated", 2) not in got                  # acknowledged in time
    assert not any(f == "x" and c == "acknowledged" for f, c, _ in got)      # forgotten after a quiet day


def test_open_alerts_are_kept(spark, frame, streamed):
    pdf = pd.DataFrame([("x", 0.0, 0, "fire", 4), ("z", 90_000.0, 1, "fire", 0), ("x", 180_000.0, 2, "acknowledge", 0)],
                       columns=["metric_name", "t", "seq", "kind", "severity"])
    df = frame(pdf).withColumns({"ts": F.timestamp_seconds(F.col("t") + 1e6), "fingerprint": F.col("metric_name"), "value": F.lit(1.0),
                                 "score": F.lit(.5), "minutes": F.lit(None).cast("double"), "severity": F.col("severity").cast("int")})
    changes = runs.run_closed(streamed(df.select(*sa.EVENT_COLUMNS), 3), lambda e: sa.alert_stream(e, "1 minute"))
    got = [(r.fingerprint, r.change) for r in changes.orderBy("fingerprint", "ts", "seq").collect()]
    assert [c for f, c in got if f == "x"] == ["fired", "acknowledged"]


def test_late_rows_inside_the_watermark_are_put_in_order(later):
    """Rows that come in parts, each up to an hour late, are scored as in one batch; rows later than that are dropped."""
    rows = later
    got = runs.run_in_turn(in_turn(rows, 5, late_hours=1), lambda r: sm.sliding_scores(r, 30, "1 hour"))
    want = SlidingZScore(30).fit_detect(rows)
    np.testing.assert_allclose(column(got, "score"), column(want, "score"), atol=1e-6)
    first, late = rows.filter("seq < 300 or seq >= 310"), rows.filter("seq between 300 and 309")
    got = runs.run_in_turn([first, late], lambda r: sm.sliding_scores(r, 30, "1 hour"))
    want = SlidingZScore(30).fit_detect(first)
    np.testing.assert_allclose(column(got, "score"), column(want, "score"), atol=1e-6)


def test_late_poll_is_no_wrap(spark, frame):
    octets = "1.3.6.1.2.1.2.2.1.10.1"
    pdf = pd.DataFrame([("h", 161, octets, v, 1e6 + t, t) for t, v in ((0, 100.0), (60, 160.0), (30, 130.0), (90, 190.0))],
                       columns=["host", "port", "oid", "value", "t", "seq"])
    df = frame(pdf).withColumns({"ts": F.timestamp_seconds("t"), "port": F.col("port").cast("int"),
                                 "labels": F.create_map(F.lit("x"), F.lit("y"))}).drop("t")
    parts = [df.filter("seq in (0, 60)"), df.filter("seq in (30, 90)")]
    got = runs.run_in_turn(parts, lambda r: sm.counter_stream(r, "1 hour", 32))
    assert column(got, "value", ("seq",)).tolist() == [100.0, 30.0, 30.0, 30.0]


@pytest.mark.parametrize("escalation", [30.0, 1e9])
def test_late_alert_events_equal_batch(history, escalation):
    """Events up to an hour late, in parts: without escalation as the batch; with it one level more where an alert is left firing."""
    fires = history.filter("kind = 'fire'")
    commands = history.filter("kind in ('acknowledge', 'resolve')").select("fingerprint", "ts", "seq", F.col("kind").alias("action"))
    silences = history.filter("kind = 'silence'").select("fingerprint", F.col("ts").alias("start_ts"), "minutes")
    want = al.episodes(fires.drop("kind", "minutes"), silences=silences, commands=commands)
    rules = sa.AlertRules(escalation_minutes=escalation, idle_hours=1.0)
    changes = runs.run_in_turn(in_turn(history.select(*sa.EVENT_COLUMNS), 4, late_hours=1), lambda e: sa.alert_stream(e, "1 hour", rules))
    got, want = as_set(sa.latest_alerts(changes)), as_set(want)
    raised = {r.id for r in changes.filter("change = 'escalated'").collect()}
    assert {(r[:2] + r[3:]) for r in got} == {(r[:2] + r[3:]) for r in want}
    higher = {r[0]: r[2] for r in want}
    assert all(r[2] == higher[r[0]] or (r[0] in raised and r[2] == higher[r[0]] + 1) for r in got)
    assert bool(raised) == (escalation == 30.0)
