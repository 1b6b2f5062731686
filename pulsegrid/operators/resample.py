"""Regular grids: time bins and fixed-size groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.ordering import DEFAULT, Layout, with_index
from pulsegrid.operators.stats import join_stats, median_interval
from pulsegrid.schema import micros

#: Grid rows one task generates for one series at a time.
GRID_CHUNK = 65_536

METHODS = ("mean", "max", "min", "sum", "last", "first")


def _bin_value(method: str) -> Column:
    v = F.col("value")
    order = F.when(v.isNotNull(), F.struct("ts", "seq"))
    aggs = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v), "sum": F.sum(v),
            "last": F.max_by(v, order), "first": F.min_by(v, order)}
    if method not in aggs:
        raise ValueError(f"unknown resampling method {method!r}, expected one of {METHODS}")
    return aggs[method]


def resample_uniform(rows: DataFrame, interval: float | None = None, method: str = "mean",
                     start: Column | None = None, end: Column | None = None,
                     layout: Layout = DEFAULT) -> DataFrame:
    """Bin each series onto an even grid from its first to its last timestamp.

    ``interval`` is in seconds (default: the median step, 1 for a single row).
    Rows outside ``start`` .. ``end`` count in the edge bins.  One row per bin:
    ``seq`` is the bin number, ``ts`` its centre, ``value`` NULL if it is empty.
    """
    value = _bin_value(method)
    span = rows.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    if interval is None:
        span = (span.join(median_interval(rows, layout), "series_id", "left")
                .withColumn("interval", F.coalesce("interval", F.lit(1.0))))
    else:
        span = span.withColumn("interval", F.lit(float(interval)))
    t0 = micros(start if start is not None else F.col("lo"))
    t1 = micros(end if end is not None else F.col("hi"))
    width = F.round(F.col("interval") * 1e6)
    span = span.select("series_id", t0.alias("t0"), width.alias("width"),
                       F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(t1 - t0, width)), F.lit(1)))
                       .cast("bigint").alias("bins"))
    binned = join_stats(rows, span, how="inner")
    where = F.floor(F.coalesce(F.try_divide(micros(F.col("ts")) - F.col("t0"), F.col("width")), F.lit(0)))
    where = F.least(F.greatest(where, F.lit(0)), F.col("bins") - 1).cast("bigint")
    binned = binned.groupBy("series_id", where.alias("seq")).agg(value.alias("value"))
    return _grid(span).join(binned, ["series_id", "seq"], "left").select("series_id", "ts", "seq", "value")


def _grid(span: DataFrame) -> DataFrame:
    """One row per bin.  Generated chunk by chunk, so a long series is spread over tasks."""
    last = F.col("bins") - 1
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / GRID_CHUNK)))
    chunks = span.withColumn("chunk", chunk).repartition("series_id", "chunk")
    lo = F.col("chunk") * GRID_CHUNK
    rows = chunks.withColumn("seq", F.explode(F.sequence(lo, F.least(last, lo + GRID_CHUNK - 1))))
    centre = F.col("t0") + (F.col("seq") + 0.5) * F.col("width")
    return rows.select("series_id", "seq", F.timestamp_micros(centre.cast("bigint")).alias("ts"))


def downsample(rows: DataFrame, factor: int, method: str = "mean", layout: Layout = DEFAULT) -> DataFrame:
    """Combine every ``factor`` consecutive rows; the last group may be shorter."""
    if factor <= 1:
        return rows
    value = {"max": F.max("value"), "min": F.min("value")}.get(method, F.avg("value"))
    return (with_index(rows, layout)
            .groupBy("series_id", F.floor(F.col("idx") / factor).cast("bigint").alias("seq"))
            .agg(F.min("ts").alias("ts"), value.alias("value")))
