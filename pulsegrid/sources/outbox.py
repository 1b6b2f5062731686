"""Notification payloads as rows: what would be sent where, for another system to deliver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.scalar import fixed
from pulsegrid.operators.alerts import alert_dict

# Fixed values.
SEVERITY_COLOURS = {"info": "#36a64f", "low": "#daa520", "medium": "#ff8c00", "high": "#ff4500",
                    "critical": "#dc143c"}
DEFAULT_COLOUR = "#808080"
PAGER_SEVERITIES = {"info": "info", "low": "warning", "medium": "warning", "high": "error",
                    "critical": "critical"}
CHANNELS = ("webhook", "email", "slack", "pagerduty")


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(default))


def _webhook() -> Column:
    return F.to_json(F.struct("id", "fingerprint", "metric_name", F.col("label").alias("severity"), "message",
                              "state", "first_seen", "last_seen", "count", "duration_minutes", "labels",
                              "value", "score"))


def _email(title: str) -> Column:
    subject = F.format_string(f"[{title} %s] %s", F.upper("label"), F.col("metric_name"))
    body = F.format_string(
        "Alert: %s\n\nMetric: %s\nValue: %s\nScore: %s\nSeverity: %s\nState: %s\nLabels: %s\n"
        "Duration: %s minutes\nCount: %d\n",
        "message", "metric_name", fixed(F.col("value"), 4), fixed(F.col("score"), 4), "label", "state",
        F.to_json("labels"), fixed(F.col("duration_minutes"), 1), "count")
    return F.to_json(F.struct(subject.alias("subject"), body.alias("body")))


def _slack(title: str, channel: str | None) -> Column:
    field = lambda name, text: F.struct(F.lit(name).alias("title"), text.alias("value"), F.lit(True).alias("short"))
    card = F.struct(
        _lookup(SEVERITY_COLOURS, F.col("label"), DEFAULT_COLOUR).alias("color"),
        F.concat(F.upper("label"), F.lit(": "), F.col("metric_name")).alias("title"),
        F.col("message").alias("text"),
        F.array(field("Value", fixed(F.col("value"), 4)),
                field("Score", fixed(F.col("score"), 4)),
                field("Duration", F.concat(fixed(F.col("duration_minutes"), 1), F.lit("m"))),
                field("Count", F.col("count").cast("string"))).alias("fields"),
        F.lit(f"{title} Anomaly Detection").alias("footer"))
    parts = [F.lit(title).alias("username"), F.array(card).alias("attachments")]
    if channel:
        parts.append(F.lit(channel).alias("channel"))
    return F.to_json(F.struct(*parts))


def _pagerduty(routing_key: str) -> Column:
    details = F.struct("value", "score", "labels", "count")
    return F.to_json(F.struct(
        F.lit(routing_key).alias("routing_key"),
        F.when(F.col("state") == "firing", "trigger").otherwise("resolve").alias("event_action"),
        F.col("fingerprint").alias("dedup_key"),
        F.struct(F.col("message").alias("summary"), F.col("metric_name").alias("source"),
                 _lookup(PAGER_SEVERITIES, F.col("label"), "warning").alias("severity"),
                 details.alias("custom_details")).alias("payload")))


def outbox(alerts: DataFrame, channels: tuple[str, ...] = CHANNELS, title: str = "Metrics",
           slack_channel: str | None = None, routing_key: str = "") -> DataFrame:
    """``(channel, dedup_key, payload)`` for every alert and channel."""
    build = {"webhook": _webhook, "email": lambda: _email(title),
             "slack": lambda: _slack(title, slack_channel), "pagerduty": lambda: _pagerduty(routing_key)}
    unknown = [c for c in channels if c not in build]
    if unknown:
        raise ValueError(f"unknown channels {unknown}, expected some of {CHANNELS}")
    rows = alert_dict(alerts).withColumnRenamed("severity", "label")
    messages = F.array(*[F.struct(F.lit(c).alias("channel"), build[c]().alias("payload")) for c in channels])
    return (rows.select("fingerprint", F.explode(messages).alias("m"))
            .select("m.channel", F.col("fingerprint").alias("dedup_key"), "m.payload"))


def on_each_batch(send: Callable[[DataFrame], None], **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands the outbox of each batch of alerts to ``send``."""
    def run(alerts: DataFrame, batch_id: int) -> None:
        send(outbox(alerts, **options))
    return run
