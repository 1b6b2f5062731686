"""How the given tables are seen as metrics, alerts, windows and device samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.scalar import severity
from pulsegrid.operators.alerts import with_fingerprint
from pulsegrid.operators.ordering import with_running
from pulsegrid.operators.resample import resample_uniform
from pulsegrid.schema import as_series, micros

HOUR = 3600.0
LARGEST = 490.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type."""
    return as_series(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric rows, the user and the ``k`` property as labels."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"),
                          F.lit("k"), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("ts"),
                    labels.alias("labels"), F.lit("events").alias("source"), F.lit("").alias("unit"),
                    F.col("event_id").alias("seq"))


def hourly(spark: SparkSession, sf_dir: str, method: str = "mean") -> DataFrame:
    return resample_uniform(events(spark, sf_dir), HOUR, method)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with low values missing: gaps at irregular times."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 20, F.col("value")))


def order_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running order value in cents per priority, as a 32-bit counter."""
    o = as_series(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return with_running(o, {"total": cents}).select(
        "series_id", "ts", "seq", (F.col("total") % 4_294_967_296).cast("double").alias("value"))


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per day and return flag."""
    li = table(spark, sf_dir, "lineitem")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    return (li.groupBy(F.col("l_returnflag").alias("series_id"), day.alias("ts")).agg(revenue.alias("value"))
            .withColumn("seq", F.lit(0).cast("bigint")))


def cumulative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped so far per day and return flag: a level that only grows."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    days = (li.groupBy(F.col("l_returnflag").alias("series_id"), day.alias("ts"))
            .agg(F.count("*").alias("n")).withColumn("seq", F.lit(0).cast("bigint")))
    return with_running(days, {"total": F.col("n")}).select(
        "series_id", "ts", "seq", F.col("total").cast("double").alias("value"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a fire of its type."""
    e = table(spark, sf_dir, "events")
    score = F.least(F.col("value") / LARGEST, F.lit(1.0))
    return with_fingerprint(e.select(
        F.col("event_type").alias("metric_name"), F.create_map().cast("map<string,string>").alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        severity(score).alias("severity"), "value", score.alias("score")))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases above 250 resolve the click alert, those below 15 acknowledge the error alert."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase' and (value > 250 or value < 15)")
    high = F.col("value") > 250
    keyed = with_fingerprint(e.select(
        F.when(high, "click").otherwise("error").alias("metric_name"),
        F.create_map().cast("map<string,string>").alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(high, "resolve").otherwise("acknowledge").alias("action")))
    return keyed.select("fingerprint", "ts", "seq", "action")


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases above 300 silence the signup alert, those below 20 the view alert, for 90 minutes."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase' and (value > 300 or value < 20)")
    keyed = with_fingerprint(e.select(
        F.when(F.col("value") > 300, "signup").otherwise("view").alias("metric_name"),
        F.create_map().cast("map<string,string>").alias("labels"),
        F.col("ts").cast("timestamp").alias("start_ts"), F.lit(90).alias("minutes")))
    return keyed.select("fingerprint", "start_ts", "minutes")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One escalation check at the start of every day that has events."""
    return table(spark, sf_dir, "events").select(
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).distinct()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as maintenance windows spread over the month, with targets by market segment."""
    c = table(spark, sf_dir, "customer")
    start = F.lit(1_704_067_200_000_000).cast("bigint") + (F.col("c_custkey") * 37 % 43_200) * 60_000_000
    target = (F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("click")))
              .when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("sign"), F.lit("err")))
              .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("purchase")))
              .when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("77"))))
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.timestamp_micros(start).alias("start_ts"),
        F.timestamp_micros(start + F.col("c_nationkey") * 30_000_000).alias("end_ts"),
        F.coalesce(target, F.array(F.lit("view"))).alias("targets"),
        (F.col("c_acctbal") > 0).alias("recalibrate"), F.col("c_mktsegment").alias("created_by"))


def device_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as polls: priority is the device, status the interface, a running total the counter."""
    o = table(spark, sf_dir, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderpriority", "o_orderstatus")
    total = with_running(o, {"total": F.col("cents")})
    unit = (F.when(F.col("o_orderstatus") == "F", "1.3.6.1.2.1.2.2.1.10.1")
            .when(F.col("o_orderstatus") == "O", "1.3.6.1.2.1.2.2.1.10.2").otherwise("1.3.6.1.2.1.1.3.0"))
    return total.select(
        F.col("o_orderpriority").alias("host"), F.lit(161).alias("port"), unit.alias("oid"),
        (F.col("total") % 4_294_967_296).cast("double").alias("value"), "ts", "seq",
        F.create_map(F.lit("site"), F.lit("a")).alias("labels"))


def in_turn(rows: DataFrame, parts: int = 4, late_hours: float = 20.0) -> list[DataFrame]:
    """``rows`` as they might come: in parts by time, but every row up to ``late_hours`` after its time, by a hash of ``seq``."""
    room = int(late_hours * 3600e6)
    at = F.unix_micros("ts") + F.pmod(F.xxhash64("seq"), F.lit(room))
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = max(1, ((hi or 0) + room - (lo or 0)) // parts + 1)
    part = F.floor((at - F.lit(lo or 0)) / step)
    return [rows.filter(part == k) for k in range(parts)]


def us(column: str = "ts"):
    return micros(F.col(column)).alias("us")
