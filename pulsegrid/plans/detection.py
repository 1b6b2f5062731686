"""From series rows to graded anomalies and alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalar import severity, severity_label
from pulsegrid.operators.alerts import episodes, fires_from_anomalies
from pulsegrid.operators.context import suppress_by_context
from pulsegrid.operators.detectors.base import Detector
from pulsegrid.operators.detectors.ensemble import Ensemble
from pulsegrid.operators.detectors.statistical import Gesd, Iqr, SeasonalResidual, ZScore
from pulsegrid.operators.forecast import with_enough_points
from pulsegrid.operators.maintenance import not_suppressed
from pulsegrid.operators.ordering import DEFAULT, Layout
from pulsegrid.operators.stats import join_stats
from pulsegrid.plans.preprocess import PreprocessConfig, preprocess
from pulsegrid.schema import ROW_KEY
from pulsegrid.session import shared


def default_detectors(threshold: float = 3.0) -> list[Detector]:
    return [ZScore(threshold), Iqr(1.5)]


@dataclass(frozen=True)
class DetectionConfig:
    """``preprocess=None`` scores the values as they are."""

    detectors: list[Detector] = field(default_factory=default_detectors)
    strategy: str = "majority"
    vote_threshold: float = 0.5
    weights: dict[str, float] = field(default_factory=dict)
    preprocess: PreprocessConfig | None = PreprocessConfig()
    #: Require more of a score outside business hours.
    use_context: bool = False
    business_hours: tuple[int, int] = (8, 18)
    schedule: dict[str, float] | None = None
    zone: str = "UTC"
    min_points: int = 0


def detect(rows: DataFrame, config: DetectionConfig = DetectionConfig(), layout: Layout = DEFAULT) -> DataFrame:
    """Anomalies of all series: ``series_id, ts, seq, value, raw, score, severity, detectors``."""
    if config.min_points:
        rows = with_enough_points(rows, config.min_points)
    if config.preprocess is None:
        clean = rows.withColumn("raw", F.col("value"))
    else:
        clean = shared(preprocess(rows.select(*ROW_KEY, "value"), config.preprocess, layout), "clean")
    ensemble = Ensemble(config.detectors, config.strategy, config.vote_threshold, config.weights)
    found = ensemble.detect(clean, keep=("raw",)).filter("is_anomaly")
    if config.use_context:
        found = suppress_by_context(found, config.business_hours, config.schedule, config.zone)
    return found.select(*ROW_KEY, "value", "raw", "score",
                        severity(F.col("score"), metric_type=F.col("series_id")).alias("severity"), "detectors")


def regrade(anomalies: DataFrame, durations: DataFrame | None = None, correlated: DataFrame | None = None) -> DataFrame:
    """Grade again with what only later steps know: ``(series_id, duration_minutes)`` and ``(metric)``."""
    minutes, linked = None, None
    if durations is not None:
        anomalies = join_stats(anomalies, durations.select("series_id", "duration_minutes"))
        minutes = F.coalesce("duration_minutes", F.lit(0.0))
    if correlated is not None:
        marks = correlated.select(F.col("metric").alias("series_id"), F.lit(True).alias("_linked"))
        anomalies = join_stats(anomalies, marks)
        linked = F.coalesce("_linked", F.lit(False))
    level = severity(F.col("score"), minutes, F.col("series_id"), linked)
    return anomalies.withColumn("severity", level).drop("_linked", "duration_minutes")


def by_method(method: str, threshold: float = 3.0) -> list[Detector]:
    """The detectors behind a method name."""
    choices = {"zscore": lambda: [ZScore(threshold)], "iqr": lambda: [Iqr(1.5)], "gesd": lambda: [Gesd()],
               "stl": lambda: [SeasonalResidual()], "ensemble": lambda: default_detectors(threshold)}
    if method not in choices:
        raise ValueError(f"unknown method {method!r}, expected one of {sorted(choices)}")
    return choices[method]()


def detection_summary(rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Points, anomalies and highest severity per series, also for quiet series."""
    points = rows.groupBy("series_id").agg(F.count("*").alias("total_points"))
    found = anomalies.groupBy("series_id").agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    return points.join(found, "series_id", "left").select(
        "series_id", "total_points", F.coalesce("n", F.lit(0)).alias("anomaly_count"),
        severity_label(F.coalesce("worst", F.lit(0))).alias("max_severity"))


def severity_rollup(anomalies: DataFrame) -> DataFrame:
    """Anomaly counts by series and severity with subtotals (an addition of this engine)."""
    return anomalies.rollup("series_id", "severity").agg(F.count("*").alias("anomalies"))


def alerts_for(anomalies: DataFrame, windows: DataFrame | None = None, silences: DataFrame | None = None,
               commands: DataFrame | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """Alerts from anomalies: maintenance, silences and de-duplication in turn."""
    if windows is not None:
        anomalies = not_suppressed(anomalies, windows)
    return episodes(fires_from_anomalies(anomalies), silences=silences, commands=commands, layout=layout)
