"""Capacity projection: trend plus season, intervals, exhaustion and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.distributions import normal_quantile, normal_tail, slope_p_value
from pulsegrid.functions.scalar import iso_time, trend_direction
from pulsegrid.operators.ordering import DEFAULT, Layout, with_index
from pulsegrid.operators.seasonal import phase_table, with_trend
from pulsegrid.operators.stats import join_stats, median_interval
from pulsegrid.schema import from_seconds, safe_div, seconds
from pulsegrid.session import shared, written

#: Values a series needs before a line is fitted, and before a season is.
MIN_POINTS = 3
MIN_SEASONAL = 14
#: Steps that count towards the risk of crossing the service level.
RISK_STEPS = 24


def with_enough_points(rows: DataFrame, at_least: int = 10) -> DataFrame:
    """Only series that have ``at_least`` rows."""
    counts = rows.groupBy("series_id").agg(F.count("*").alias("_n"))
    return join_stats(rows, counts.filter(F.col("_n") >= at_least).select("series_id"), how="left_semi")


def with_too_few_points(rows: DataFrame, at_least: int = 10) -> DataFrame:
    """The series that guard turns away, with their row counts."""
    counts = rows.groupBy("series_id").agg(F.count("*").alias("points"))
    return counts.filter(F.col("points") < at_least)


def _compact(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows with a value, numbered without the gaps the others leave."""
    valid = rows.filter("value is not null").select("series_id", "ts", "seq", "value")
    return written(with_index(valid, layout).drop("cell", "sub"), "valid")


def fit_line(indexed: DataFrame) -> DataFrame:
    """Least-squares line of value on position, with the terms intervals need."""
    x, y = F.col("idx").cast("double"), F.col("value")
    sums = indexed.groupBy("series_id").agg(
        F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"), F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("sd"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.max_by(y, x).alias("current_value"))
    left = F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"), F.lit(0.0))
    # a constant explains nothing, where SQL says it explains all
    fit = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(F.col("r_squared"))
    return sums.withColumns({"residual_sd": F.sqrt(left), "r_squared": fit}).drop("syy", "sxy").filter(F.col("n") >= MIN_POINTS)


def fit_forecast(rows: DataFrame, interval: float | None = None, layout: Layout = DEFAULT,
                 ) -> tuple[DataFrame, DataFrame]:
    """Everything a projection needs: one row per series, and its seasonal phases."""
    compact = _compact(rows, layout)
    line = fit_line(compact)
    ends = rows.groupBy("series_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("points"))
    line = line.join(ends.filter(F.col("points") >= MIN_POINTS).drop("points"), "series_id")
    if interval is None:
        line = line.join(median_interval(rows, layout), "series_id")
    else:
        line = line.withColumn("interval", F.lit(float(interval)))
    long = line.filter(F.col("n") >= MIN_SEASONAL).select("series_id")
    trended = shared(with_trend(join_stats(compact, long, how="left_semi"), None, layout), "trended")
    periods = trended.groupBy("series_id").agg(F.first("period").alias("period"))
    fitted = written(line.join(periods, "series_id", "left"), "fit")
    return fitted, written(phase_table(trended), "phases")


def _half_width(step: Column, z: float) -> Column:
    """Half width of the prediction interval ``step`` positions after the last."""
    n = F.col("n")
    from_middle = n + step - (n - 1) / 2
    spread = n * (n * n - 1) / 12
    return F.lit(z) * F.col("residual_sd") * F.sqrt(1 + 1 / n + from_middle * from_middle / spread)


def project(fitted: DataFrame, phases: DataFrame, horizon: int = 168, confidence: float = 0.95) -> DataFrame:
    """One row per series and future step: ``step, ts, predicted, lower, upper``."""
    z = normal_quantile((1 + confidence) / 2)
    steps = fitted.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    steps = steps.withColumn("phase", (F.col("n") + F.col("step")) % F.col("period"))
    steps = steps.join(phases, ["series_id", "phase"], "left")
    line = F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")
    predicted = line + F.coalesce(F.col("seasonal"), F.lit(0.0))
    width = _half_width(F.col("step"), z)
    at = from_seconds(seconds(F.col("last_ts")) + (F.col("step") + 1) * F.col("interval"))
    return steps.select("series_id", "step", at.alias("ts"), predicted.alias("predicted"),
                        (predicted - width).alias("lower"), (predicted + width).alias("upper"))


def sla_risk(points: DataFrame, threshold: float, confidence: float = 0.95) -> DataFrame:
    """Largest chance, over the first steps, that the value exceeds ``threshold``."""
    z = normal_quantile((1 + confidence) / 2)
    sd = (F.col("upper") - F.col("predicted")) / z
    chance = F.when(sd > 0, normal_tail(safe_div(F.lit(threshold) - F.col("predicted"), sd)))
    near = points.filter(F.col("step") < RISK_STEPS)
    return (near.withColumn("_p", chance).groupBy("series_id")
            .agg(F.coalesce(F.max("_p"), F.lit(0.0)).alias("sla_risk_score")))


def summarize(fitted: DataFrame, confidence: float = 0.95, capacity_threshold: float | None = None,
              horizon: int = 168, zone: str = "UTC") -> DataFrame:
    """Trend per second, and when the trend line reaches the capacity."""
    level = F.col("slope") * F.col("n") + F.col("intercept")
    capacity = F.lit(capacity_threshold).cast("double")
    rising = (F.col("slope") > 0) & (level < capacity)
    ahead = F.when(rising, safe_div(capacity - level, F.col("slope")) * F.col("interval"))
    at = from_seconds(seconds(F.col("last_ts")) + ahead)
    per_second = F.when(F.col("interval") > 0, safe_div(F.col("slope"), F.col("interval"))).otherwise(F.col("slope"))
    return fitted.select(
        "series_id", F.lit(confidence).alias("confidence"), per_second.alias("trend_slope"),
        F.lit(horizon).alias("n_points"), at.alias("exhaustion_ts"),
        iso_time(at, zone).alias("exhaustion_date"), (ahead / 86_400).alias("days_to_exhaustion"))


def forecast(rows: DataFrame, horizon: int = 168, interval: float | None = None, confidence: float = 0.95,
             capacity_threshold: float | None = None, sla_threshold: float | None = None, zone: str = "UTC",
             layout: Layout = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Projected points, and one summary row per series.

    Series with under three rows or values have neither.
    """
    fitted, phases = fit_forecast(rows, interval, layout)
    points = project(fitted, phases, horizon, confidence)
    summary = summarize(fitted, confidence, capacity_threshold, horizon, zone)
    if sla_threshold is None:
        return points, summary.withColumn("sla_risk_score", F.lit(0.0))
    return points, summary.join(sla_risk(points, sla_threshold, confidence), "series_id", "left")


def trend_summary(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Slope, fit, significance and level per series; ``status`` says if there were too few values."""
    line = fit_line(_compact(rows, layout))
    line = line.withColumn("p_value", slope_p_value(F.col("r_squared"), F.col("n")))
    out = rows.select("series_id").distinct().join(line, "series_id", "left")
    return out.select(
        "series_id", F.when(F.col("n").isNull(), "insufficient_data").otherwise("ok").alias("status"),
        "slope", "r_squared", "p_value", (F.col("p_value") < 0.05).alias("significant"),
        F.when(F.col("n").isNotNull(), trend_direction(F.col("slope"))).alias("direction"),
        "current_value", "mean", "sd")
