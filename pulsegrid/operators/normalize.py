"""Normalisation, with parameters that can be saved and applied to other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalar import log_normalize as log_column
from pulsegrid.operators.stats import guarded, join_stats, moments, quantiles
from pulsegrid.schema import safe_div


def fit_zscore(rows: DataFrame) -> DataFrame:
    return moments(rows).select("series_id", "mean", "sd")


def z_normalize(rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sd; a constant series becomes 0."""
    joined = join_stats(rows, params if params is not None else fit_zscore(rows))
    z = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise(safe_div(F.col("value") - F.col("mean"), F.col("sd")))
    return joined.withColumn("value", z).drop("mean", "sd")


def fit_minmax(rows: DataFrame) -> DataFrame:
    return moments(rows).select("series_id", "vmin", "vmax")


def minmax_normalize(rows: DataFrame, params: DataFrame | None = None,
                     feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Map the range of a series to ``feature_range``; a constant series becomes the lower bound."""
    low, high = feature_range
    joined = join_stats(rows, params if params is not None else fit_minmax(rows))
    span = F.col("vmax") - F.col("vmin")
    scaled = safe_div(F.col("value") - F.col("vmin"), span) * F.lit(high - low) + F.lit(low)
    return (joined.withColumn("value", F.when(span == 0, F.lit(float(low))).otherwise(scaled))
            .drop("vmin", "vmax"))


def fit_robust(rows: DataFrame) -> DataFrame:
    q = quantiles(rows, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.when(F.col("n") >= 4, F.col("q3") - F.col("q1"))
    return q.select("series_id", "median", guarded(iqr).alias("iqr"))


def robust_normalize(rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(value - median) / interquartile range (1 if that is 0 or there are under 4 values)."""
    joined = join_stats(rows, params if params is not None else fit_robust(rows))
    return (joined.withColumn("value", (F.col("value") - F.col("median")) / guarded(F.col("iqr")))
            .drop("median", "iqr"))


def log_normalize(rows: DataFrame, offset: float = 1.0) -> DataFrame:
    return rows.withColumn("value", log_column(F.col("value"), offset))
