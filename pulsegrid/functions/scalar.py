"""Column functions: counter deltas, logs, time of day, severity, messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.schema import micros

# Fixed values.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
SEVERITY_EMOJI = ["ℹ️", "🟡", "🟠", "🔴", "🚨"]
CRITICAL_TYPES = ["error_rate", "packet_loss", "disk_full", "oom"]
SENSITIVITY = {"business_hours": 1.0, "after_hours": 1.5, "weekend": 2.0, "night": 2.0}
COUNTER_NAME = r"(_total|_count|_sum)$|octets|packets|errors|bytes|frames|drops"


def wrap_delta(current: Column, previous: Column, bits: int = 64) -> Column:
    """Increase of a counter that starts over at 2^bits (64, or else 32)."""
    span = F.lit(2.0 ** (64 if bits == 64 else 32))
    return F.when(current >= previous, current - previous).otherwise(span - previous + current)


def is_counter_name(name: Column) -> Column:
    return F.lower(name).rlike(COUNTER_NAME)


def log_normalize(value: Column, offset: float = 1.0) -> Column:
    """log1p(max(value, 0) + offset - 1); a missing value stays missing."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0)) + F.lit(offset - 1.0)))


def local_time(ts: Column, zone: str = "UTC") -> Column:
    """Wall clock of a zone at an instant, whatever the zone of the session."""
    utc = F.timestamp_add("MICROSECOND", micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) if zone != "UTC" else utc


def temporal_context(ts: Column, business_hours: tuple[int, int] = (8, 18),
                     zone: str = "UTC") -> dict[str, Column]:
    """hour, day_of_week (Monday 0), is_weekend and is_business_hours of a timestamp."""
    t = local_time(ts, zone)
    hour, day = F.hour(t), F.weekday(t)
    weekend = day >= 5
    opens, closes = business_hours
    return {"hour": hour, "day_of_week": day, "is_weekend": weekend,
            "is_business_hours": (hour >= opens) & (hour < closes) & ~weekend}


def threshold_multiplier(ts: Column, business_hours: tuple[int, int] = (8, 18),
                         schedule: dict[str, float] | None = None, zone: str = "UTC") -> Column:
    """How much less sensitive detection is at this time of the week."""
    s = {**SENSITIVITY, **(schedule or {})}
    c = temporal_context(ts, business_hours, zone)
    return (F.when(c["is_weekend"], F.lit(s["weekend"]))
            .when(c["is_business_hours"], F.lit(s["business_hours"]))
            .when(c["hour"] < 6, F.lit(s["night"]))
            .otherwise(F.lit(s["after_hours"])))


def severity(score: Column, duration_minutes: Column | None = None, metric_type: Column | None = None,
             correlated: Column | None = None) -> Column:
    """Severity 0..4 of a score in [0, 1], raised by duration, metric type and correlation.

    A missing or NaN score has the lowest grade.
    """
    score = F.nanvl(score.cast("double"), F.lit(0.0))
    level = (F.when(score >= 0.9, 4).when(score >= 0.7, 3)
             .when(score >= 0.5, 2).when(score >= 0.3, 1).otherwise(0))
    if duration_minutes is not None:
        level = (F.when(duration_minutes > 30, F.least(F.lit(4), level + 1))
                 .when((duration_minutes > 10) & (level < 3), level + 1)
                 .otherwise(level))
    if metric_type is not None:
        critical = F.coalesce(F.lower(metric_type).isin(CRITICAL_TYPES), F.lit(False))
        level = F.when(critical & (level < 3), level + 1).otherwise(level)
    if correlated is not None:
        level = F.when(correlated & (level < 4), level + 1).otherwise(level)
    return level.cast("int")


def _named(names: list[str], level: Column, default: str) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.get(table, level), F.lit(default))


def severity_label(level: Column) -> Column:
    return _named(SEVERITIES, level, "unknown")


def severity_emoji(level: Column) -> Column:
    return _named(SEVERITY_EMOJI, level, "❓")


def fixed(x: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals, rounding the stored binary value."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def alert_message(name: Column, value: Column, score: Column) -> Column:
    return F.format_string("Anomaly detected on %s: value=%s, score=%s", name, fixed(value, 2), fixed(score, 2))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(6e7)


def iso_time(ts: Column, zone: str = "UTC") -> Column:
    """ISO-8601 date and time in a zone, to the second."""
    return F.translate(F.substring(local_time(ts, zone).cast("string"), 1, 19), " ", "T")


def trend_direction(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable")
