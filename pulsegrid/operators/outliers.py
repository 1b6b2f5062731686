"""Outlier masks and what to put in place of outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.stats import clamp, join_stats, mad, moments, quantiles
from pulsegrid.schema import safe_div
from pulsegrid.session import shared

METHODS = ("iqr", "zscore", "modified_zscore")
REPLACEMENTS = ("nan", "median", "mean", "clip")


def _flag(rows: DataFrame, condition, *drop: str) -> DataFrame:
    return rows.withColumn("is_outlier", F.coalesce(condition, F.lit(False))).drop(*drop)


def outliers_iqr(rows: DataFrame, factor: float = 1.5) -> DataFrame:
    """Strictly outside the quartile fences; needs 4 values."""
    q = quantiles(rows, {"_q1": 0.25, "_q3": 0.75}).withColumnRenamed("n", "_n")
    v, q1, q3 = F.col("value"), F.col("_q1"), F.col("_q3")
    reach = factor * (q3 - q1)
    fences = (F.col("_n") >= 4) & ~F.isnan(reach)
    return _flag(join_stats(rows, q), fences & ((v < q1 - reach) | (v > q3 + reach)),
                 "_n", "_q1", "_q3")


def outliers_zscore(rows: DataFrame, threshold: float = 3.0) -> DataFrame:
    """More than ``threshold`` standard deviations from the mean; needs 2 values."""
    m = moments(rows).select("series_id", F.col("n").alias("_n"), F.col("mean").alias("_m"),
                             F.col("sd").alias("_s"))
    z = F.abs(safe_div(F.col("value") - F.col("_m"), F.col("_s")))
    return _flag(join_stats(rows, m), (F.col("_n") >= 2) & ~F.isnan(z) & (z > threshold), "_n", "_m", "_s")


def outliers_modified_zscore(rows: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Same, around the median and scaled by the median absolute deviation."""
    m = mad(rows).select("series_id", F.col("n").alias("_n"), F.col("median").alias("_m"),
                         F.col("mad").alias("_s"))
    z = F.abs(safe_div(0.6745 * (F.col("value") - F.col("_m")), F.col("_s")))
    return _flag(join_stats(rows, m), (F.col("_n") >= 2) & ~F.isnan(z) & (z > threshold), "_n", "_m", "_s")


def mark_outliers(rows: DataFrame, method: str = "iqr", **options) -> DataFrame:
    """Add ``is_outlier`` by the named method."""
    if method == "iqr":
        return outliers_iqr(rows, **options)
    if method == "zscore":
        return outliers_zscore(rows, **options)
    if method == "modified_zscore":
        return outliers_modified_zscore(rows, **options)
    raise ValueError(f"unknown outlier method {method!r}, expected one of {METHODS}")


def clip_outliers(rows: DataFrame, lower_percentile: float = 1.0,
                  upper_percentile: float = 99.0) -> DataFrame:
    """Clamp values to two percentiles; needs 2 values."""
    q = quantiles(rows, {"_lo": lower_percentile / 100, "_hi": upper_percentile / 100})
    q = q.withColumnRenamed("n", "_n")
    v = F.col("value")
    clamped = F.when(F.col("_n") >= 2, clamp(v, F.col("_lo"), F.col("_hi"))).otherwise(v)
    return join_stats(rows, q).withColumn("value", clamped).drop("_n", "_lo", "_hi")


def replace_outliers(rows: DataFrame, method: str = "iqr", replacement: str = "nan",
                     **options) -> DataFrame:
    """Replace outliers by nothing, or by a statistic of the values that are not outliers."""
    if replacement not in REPLACEMENTS:
        raise ValueError(f"unknown replacement {replacement!r}, expected one of {REPLACEMENTS}")
    marked = shared(mark_outliers(shared(rows, "rows"), method, **options), "marked")
    v, bad = F.col("value"), F.col("is_outlier")
    if replacement == "nan":
        return marked.withColumn("value", F.when(~bad, v)).drop("is_outlier")
    good = marked.withColumn("value", F.when(~bad, v))
    if replacement == "median":
        stats, new = quantiles(good, {"_r": 0.5}).drop("n"), F.col("_r")
    elif replacement == "mean":
        stats, new = good.groupBy("series_id").agg(F.avg("value").alias("_r")), F.col("_r")
    else:
        stats = good.groupBy("series_id").agg(F.min("value").alias("_r0"), F.max("value").alias("_r1"))
        new = F.coalesce(clamp(v, F.col("_r0"), F.col("_r1")), v)
    return (join_stats(marked, stats).withColumn("value", F.when(bad, new).otherwise(v))
            .drop("is_outlier", "_r", "_r0", "_r1"))
