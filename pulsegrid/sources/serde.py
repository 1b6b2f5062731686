"""Rows to JSON texts and back, with the defaults absent fields get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.scalar import SEVERITIES, iso_time, minutes_between, severity_label
from pulsegrid.schema import from_seconds, seconds
from pulsegrid.operators.alerts import alert_dict

_METRIC = ("name string, value double, timestamp double, labels map<string,string>, source string, unit string")
_ANOMALY = ("metric_name string, timestamp double, value double, score double, severity string, "
            "detectors array<string>, labels map<string,string>")


def metrics_to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(
        "name", "value", seconds(F.col("ts")).alias("timestamp"), "labels", "source", "unit")).alias("json"))


def metrics_from_json(texts: DataFrame, column: str = "json", received: Column | None = None) -> DataFrame:
    d = F.from_json(F.col(column), _METRIC)
    now = received if received is not None else F.current_timestamp()
    return texts.select(d.alias("d")).select(
        "d.name", "d.value", F.coalesce(from_seconds(F.col("d.timestamp")), now).alias("ts"),
        F.coalesce("d.labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.coalesce("d.source", F.lit("unknown")).alias("source"), F.coalesce("d.unit", F.lit("")).alias("unit"))


def anomalies_to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(
        "metric_name", seconds(F.col("ts")).alias("timestamp"), "value", "score",
        severity_label(F.col("severity")).alias("severity"), "detectors", "labels")).alias("json"))


def anomalies_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return texts.select(F.from_json(F.col(column), _ANOMALY).alias("d")).select(
        "d.metric_name", from_seconds(F.col("d.timestamp")).alias("ts"), "d.value", "d.score",
        (F.array_position(names, F.col("d.severity")) - 1).cast("int").alias("severity"), "d.detectors", "d.labels")


def alerts_to_json(alerts: DataFrame) -> DataFrame:
    flat = alert_dict(alerts)
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("json"))


def windows_to_json(windows: DataFrame, as_of: Column) -> DataFrame:
    return windows.select(F.to_json(F.struct(
        "id", "name", seconds(F.col("start_ts")).alias("start_time"), seconds(F.col("end_ts")).alias("end_time"),
        "targets", "recalibrate", as_of.between(F.col("start_ts"), F.col("end_ts")).alias("is_active"),
        minutes_between(F.col("start_ts"), F.col("end_ts")).alias("duration_minutes"))).alias("json"))


def forecasts_to_json(summary: DataFrame, zone: str = "UTC") -> DataFrame:
    """Exhaustion appears only where there is one (``to_json`` leaves NULL fields out)."""
    return summary.select("series_id", F.to_json(F.struct(
        "confidence", "trend_slope", "sla_risk_score", "n_points",
        iso_time(F.col("exhaustion_ts"), zone).alias("exhaustion_date"), "days_to_exhaustion")).alias("json"))
