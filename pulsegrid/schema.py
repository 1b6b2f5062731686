"""Row shapes shared by the whole engine, and the rules every source obeys.

A *metric row* is ``(name, value, ts, labels, source, unit)``.  A *series row*
adds ``series_id`` (the unit of analysis) and ``seq`` (the tie-breaker for rows
that share a timestamp).  A missing value is NULL, never NaN, because Spark's
aggregates skip NULL but are poisoned by NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

METRIC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("unit", T.StringType()),
])

ANOMALY_SCHEMA = T.StructType([
    T.StructField("metric_name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("detectors", T.ArrayType(T.StringType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])

WINDOW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("recalibrate", T.BooleanType()),
    T.StructField("created_by", T.StringType()),
])

#: Columns that identify one sample of one series.
ROW_KEY = ["series_id", "ts", "seq"]


def null_if_nan(c: Column) -> Column:
    """NaN means missing: turn it into NULL (infinities are kept)."""
    return F.when(~F.isnan(c), c)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def from_seconds(sec: Column) -> Column:
    """Epoch seconds (floating point) to TIMESTAMP, to the nearest microsecond."""
    return F.timestamp_micros(F.round(sec.cast("double") * 1e6).cast("bigint"))


def empty_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def as_series(df: DataFrame, name: str, ts: str, value: str, seq: str,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """View any table as series rows; only the named columns are read."""
    return df.select(
        F.col(name).cast("string").alias("series_id"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(seq).cast("bigint").alias("seq"),
        null_if_nan(F.col(value).cast("double")).alias("value"),
        *keep,
    )


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (also under ANSI mode)."""
    return F.try_divide(a, b)
