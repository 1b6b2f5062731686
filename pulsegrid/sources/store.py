"""The metric store: Parquet partitioned by day, and the reports read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pulsegrid.functions.scalar import local_time
from pulsegrid.operators.ordering import last_per_series
from pulsegrid.schema import from_seconds, null_if_nan
from pulsegrid.sources.text import number

_PAYLOAD = "array<struct<name:string,value:string,timestamp:string,labels:map<string,string>>>"


def parse_payloads(payloads: DataFrame, column: str = "value", received: Column | None = None) -> DataFrame:
    """Metric rows from JSON texts, each one object or a list; entries need a name and a value, as a number or as text."""
    rows = payloads.select(F.explode(F.from_json(F.col(column), _PAYLOAD)).alias("e"))
    now = received if received is not None else F.current_timestamp()
    value, at = number(F.col("e.value")), number(F.col("e.timestamp"))
    return rows.filter((F.col("e.name") != "") & value.isNotNull()).select(
        F.col("e.name").alias("name"), null_if_nan(value).alias("value"),
        F.coalesce(from_seconds(null_if_nan(at)), now).alias("ts"),
        F.coalesce("e.labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.lit("unknown").alias("source"), F.lit("").alias("unit"))


def append(metrics: DataFrame, path: str) -> int:
    """Append to the store; returns how many rows were written."""
    seen = Observation()
    (metrics.observe(seen, F.count("*").alias("ingested"))
     .withColumn("day", local_time(F.col("ts")).cast("date")).write.mode("append").partitionBy("day").parquet(path))
    return int(seen.get["ingested"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog(rows: DataFrame, name: str = "name") -> DataFrame:
    """Metric names in order, with their number of points."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("points")).orderBy("name")


def names(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.select(F.col(name).alias("name")).distinct()


def by_name(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("name") == name)


def by_label(rows: DataFrame, key: str, value: str) -> DataFrame:
    from pulsegrid.functions.labels import label_equals

    return rows.filter(label_equals(F.col("labels"), key, value))


def last_points(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest ``limit`` rows of every series (all rows for 0)."""
    return rows if limit == 0 else last_per_series(rows, limit)


def top_anomalies(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """The highest scores over all series."""
    return anomalies.orderBy(F.desc("score"), "series_id", "ts", "seq").limit(limit)


def write_anomalies(anomalies: DataFrame, path: str, format: str = "json") -> None:
    anomalies.write.mode("overwrite").format(format).save(path)
