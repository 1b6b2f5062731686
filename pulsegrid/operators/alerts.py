"""Alerts: fires merged into episodes, silences, commands, escalation.

A *fire* is ``(metric_name, labels, ts, seq, severity, value, score)``.  All
times are event times; nothing here reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions.labels import alert_fingerprint, literal_labels
from pulsegrid.functions.scalar import alert_message, minutes_between, severity_label
from pulsegrid.operators.ordering import DEFAULT, Layout, with_latest, with_neighbour, with_running
from pulsegrid.schema import micros
from pulsegrid.session import shared, sized

DEDUP_SECONDS = 300.0
ESCALATION_MINUTES = 30.0


def fires_from_anomalies(anomalies: DataFrame) -> DataFrame:
    """One fire per anomaly, under the metric's name and without labels."""
    return anomalies.select(
        F.col("series_id").alias("metric_name"), literal_labels(None).alias("labels"),
        "ts", "seq", "severity", "value", "score")


def with_fingerprint(fires: DataFrame) -> DataFrame:
    return fires.withColumn("fingerprint", alert_fingerprint(F.col("metric_name"), F.col("labels")))


def silence_spans(silences: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """``(fingerprint, start_ts, until_ts)`` from ``(fingerprint, start_ts, minutes)``.

    A later silence of the same fingerprint replaces the one before it.
    """
    line = silences.select(F.col("fingerprint").alias("series_id"), F.col("start_ts").alias("ts"),
                           F.lit(0).cast("bigint").alias("seq"), "minutes")
    line = with_neighbour(line, ["ts"], "next", forward=True, layout=layout)
    end = F.timestamp_micros((micros(F.col("ts")) + F.col("minutes").cast("double") * 60e6).cast("bigint"))
    return line.select(F.col("series_id").alias("fingerprint"), F.col("ts").alias("start_ts"),
                       F.least(end, F.coalesce("next_ts", end)).alias("until_ts"))


def _with_muted(rows: DataFrame, silences: DataFrame, key: str = "fingerprint", layout: Layout = DEFAULT) -> DataFrame:
    """Add ``muted``, whether a silence of the row's fingerprint covers its time; rows without one of the two are left out.

    The spans of a fingerprint do not overlap, so the last one that began decides: rows and spans are laid on one timeline, and
    no row meets all the spans of its fingerprint.
    """
    spans = silence_spans(silences, layout).filter("until_ts > start_ts").select(
        F.col("fingerprint").alias("series_id"), F.col("start_ts").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"), "until_ts")
    line = rows.select(F.col(key).alias("series_id"), "ts", F.lit(1).cast("bigint").alias("seq"), F.struct("*").alias("_row"))
    line = line.unionByName(spans, allowMissingColumns=True)
    line = with_latest(line, F.col("seq") == 0, ["until_ts"], "span", layout=layout).filter("seq = 1")
    return line.select("_row.*", F.coalesce(F.col("ts") < F.col("span.until_ts"), F.lit(False)).alias("muted"))


def silenced(fires: DataFrame, silences: DataFrame) -> DataFrame:
    return _with_muted(fires, silences).filter("muted").drop("muted")


def not_silenced(fires: DataFrame, silences: DataFrame) -> DataFrame:
    apart = fires.filter("fingerprint is null or ts is null")
    return _with_muted(fires, silences).filter("not muted").drop("muted").unionByName(apart)


def episodes(fires: DataFrame, dedup_seconds: float = DEDUP_SECONDS, silences: DataFrame | None = None,
             commands: DataFrame | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """Alerts: runs of fires of one fingerprint less than ``dedup_seconds`` apart.

    A fire inside a silence joins no run; it only marks the alert that is open at
    the time as silenced.  ``commands`` are ``(fingerprint, ts, seq, action)``
    with ``acknowledge`` or ``resolve``; a resolve closes the run, so the next
    fire starts another.  ``is_current`` is the last alert of a fingerprint.
    """
    facts = ["severity", "value", "score", "metric_name", "message"]
    if "fingerprint" not in fires.columns:
        fires = with_fingerprint(fires)
    if "message" not in fires.columns:
        fires = fires.withColumn("message", alert_message(F.col("metric_name"), F.col("value"), F.col("score")))
    events = fires.select(F.col("fingerprint").alias("series_id"), "ts", "seq",
                          F.lit("fire").alias("kind"), *facts, F.to_json("labels").alias("labels"))
    rest = None
    if silences is not None:
        events = shared(_with_muted(events, silences, "series_id", layout), "fires")
        rest = events.filter("muted").withColumn("kind", F.lit("muted")).drop("muted")
        events = events.filter("not muted").drop("muted")
    if commands is not None:
        given = commands.select(F.col("fingerprint").alias("series_id"), "ts", "seq",
                                F.col("action").alias("kind"))
        events = events.unionByName(given.filter("kind = 'resolve'"), allowMissingColumns=True)
        acks = given.filter("kind = 'acknowledge'")
        rest = acks if rest is None else rest.unionByName(acks, allowMissingColumns=True)

    marked = with_neighbour(events, ["ts", "kind"], layout=layout)
    apart = micros(F.col("ts")) - micros(F.col("prev_ts")) >= dedup_seconds * 1e6
    fresh = (F.col("kind") == "fire") & F.coalesce(apart | (F.col("prev_kind") == "resolve"), F.lit(True))
    marked = marked.withColumn("starts", fresh.cast("bigint")).drop("cell", "sub", "prev_ts", "prev_kind")
    if rest is not None:
        marked = marked.unionByName(rest.withColumn("starts", F.lit(0).cast("bigint")), allowMissingColumns=True)
    numbered = with_running(shared(marked, "events"), {"episode": F.col("starts")}, layout).filter("episode > 0")

    order = F.struct("ts", "seq")
    fired = F.col("kind") == "fire"
    change = (F.when(F.col("starts") == 1, "firing").when(F.col("kind") == "acknowledge", "acknowledged")
              .when(F.col("kind") == "muted", "silenced"))
    last = lambda c: F.max_by(c, F.when(fired, order))
    first = lambda c: F.min_by(c, F.when(fired, order))
    runs = numbered.groupBy("series_id", "episode").agg(
        first("metric_name").alias("metric_name"), first("labels").alias("labels"),
        first("message").alias("message"), F.max(F.when(fired, F.col("severity"))).alias("severity"),
        last("value").alias("value"), last("score").alias("score"),
        F.min(F.when(fired, F.col("ts"))).alias("first_seen"), F.max(F.when(fired, F.col("ts"))).alias("last_fire"),
        F.count_if(fired).alias("count"), F.min(F.when(F.col("kind") == "resolve", F.col("ts"))).alias("resolved_at"),
        F.max_by(change, F.when(change.isNotNull(), order)).alias("state"))
    runs = shared(runs, "runs")
    newest = runs.groupBy("series_id").agg(F.max("episode").alias("newest"))
    runs = runs.join(sized(newest, "newest"), "series_id")
    return runs.select(
        F.format_string("alert-%s-%d", F.col("series_id"),
                        F.floor(micros(F.col("first_seen")) / 1e6).cast("bigint")).alias("id"),
        F.col("series_id").alias("fingerprint"), "episode", "metric_name", "severity", "message",
        F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise(F.col("state")).alias("state"),
        "first_seen", F.coalesce("resolved_at", "last_fire").alias("last_seen"), "count",
        minutes_between(F.col("first_seen"), F.coalesce("resolved_at", "last_fire")).alias("duration_minutes"),
        F.from_json("labels", "map<string,string>").alias("labels"), "value", "score",
        (F.col("episode") == F.col("newest")).alias("is_current"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    """The alert of each fingerprint that still stands, silenced ones included."""
    return alerts.filter(F.col("is_current") & (F.col("state") != "resolved"))


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("is_current") & F.col("state").isin("firing", "acknowledged"))


def history(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("state") == "resolved")


def escalate(alerts: DataFrame, ticks: DataFrame, after_minutes: float = ESCALATION_MINUTES,
             layout: Layout = DEFAULT) -> DataFrame:
    """Raise firing alerts one level per tick later than ``after_minutes`` from their start.

    ``ticks`` has one ``ts`` per check.  Alerts and ticks are laid on one
    timeline and the ticks up to each alert's deadline are a running total.
    """
    firing = alerts.filter(F.col("is_current") & (F.col("state") == "firing"))
    deadline = F.timestamp_micros((micros(F.col("first_seen")) + F.lit(after_minutes * 6e7)).cast("bigint"))
    line = (firing.select("fingerprint", deadline.alias("ts"), F.lit(1).cast("bigint").alias("seq"),
                          F.lit(0).alias("tick"))
            .unionByName(ticks.select("ts", F.lit(0).cast("bigint").alias("seq"), F.lit(1).alias("tick")),
                         allowMissingColumns=True)
            .withColumn("series_id", F.lit("all")))
    total = ticks.agg(F.count("*").alias("n")).first()["n"]
    passed = (with_running(line, {"passed": F.col("tick")}, layout).filter("tick = 0")
              .select("fingerprint", (F.lit(total) - F.col("passed")).alias("raises")))
    out = alerts.join(passed, "fingerprint", "left")
    raised = F.least(F.lit(4), F.col("severity") + F.col("raises")).cast("int")
    return out.withColumn("severity", F.when(F.col("is_current") & F.col("raises").isNotNull(), raised)
                          .otherwise(F.col("severity"))).drop("raises")


def health(alerts: DataFrame, active_windows: DataFrame) -> DataFrame:
    """One row: open alerts and active maintenance windows."""
    counts = (open_alerts(alerts).agg(F.count("*").alias("active_alerts"))
              .unionByName(active_windows.agg(F.count("*").alias("active_maintenance_windows")),
                           allowMissingColumns=True))
    return counts.agg(F.max("active_alerts").alias("active_alerts"),
                      F.max("active_maintenance_windows").alias("active_maintenance_windows"))


def alert_dict(alerts: DataFrame) -> DataFrame:
    """Alerts in their outward shape: epoch seconds and a severity name."""
    return alerts.select(
        "id", "fingerprint", "metric_name", severity_label(F.col("severity")).alias("severity"), "message",
        "state", (micros(F.col("first_seen")) / 1e6).alias("first_seen"),
        (micros(F.col("last_seen")) / 1e6).alias("last_seen"), "count", "duration_minutes", "labels",
        "value", "score")
