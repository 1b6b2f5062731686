"""One-step forecasts and the detector that flags values outside their interval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.distributions import normal_quantile
from pulsegrid.operators.detectors.base import Detector, scored
from pulsegrid.operators.ordering import DEFAULT, Layout, framed, last_per_series, with_index
from pulsegrid.operators.stats import join_stats
from pulsegrid.schema import ROW_KEY, safe_div
from pulsegrid.session import shared

#: Rows that must come before a row that is scored (fewer if the context is shorter).
MIN_CONTEXT = 20


def trend_forecast(recent: Column) -> Column:
    """Struct of ``level`` (last value), least-squares ``slope`` and ``spread`` (sd) of an array.

    One pass with running mean and squares.  A single value has slope 0 and sd 1;
    none at all forecasts 0 with sd 0.
    """
    zero = F.lit(0.0)
    start = F.struct(zero.alias("m"), zero.alias("mean"), zero.alias("sq"), zero.alias("iv"), zero.alias("level"))

    def add(a: Column, v: Column) -> Column:
        m, off = a["m"] + 1, v - a["mean"]
        mean = a["mean"] + off / m
        return F.struct(m.alias("m"), mean.alias("mean"), (a["sq"] + off * (v - mean)).alias("sq"),
                        (a["iv"] + a["m"] * v).alias("iv"), v.alias("level"))

    def finish(a: Column) -> Column:
        m = a["m"]
        slope = F.when(m >= 2, safe_div(a["iv"] - (m - 1) / 2 * a["mean"] * m, m * (m * m - 1) / 12))
        spread = F.when(m > 1, F.sqrt(safe_div(a["sq"], m))).when(m == 1, F.lit(1.0))
        return F.struct(a["level"].alias("level"), F.coalesce(slope, zero).alias("slope"),
                        F.coalesce(spread, zero).alias("spread"))

    return F.aggregate(recent, start, add, finish)


def _recent(rows: DataFrame, context: int, trend_window: int, layout: Layout) -> DataFrame:
    """Add ``recent``: the last ``trend_window`` values among the ``context`` rows before each row.

    Takes rows that have a value; ``idx`` still counts those that have none.
    """
    # frames run over the rows with a value, numbered anew
    valid = rows.filter("value is not null").withColumnRenamed("idx", "at")
    near = F.struct("at", "value")
    valid = framed(valid.drop("cell", "sub"), trend_window, 0, lambda w: {
        "_near": F.collect_list(near).over(w.rowsBetween(-trend_window, -1))}, layout)
    inside = F.filter("_near", lambda e: e["at"] >= F.col("at") - context)
    return valid.withColumn("recent", F.transform(inside, lambda e: e["value"])).drop("_near", "idx", "cell", "sub")


class ForecastInterval(Detector):
    """Distance from a one-step forecast in half interval widths; outside it is an anomaly.

    ``fit`` keeps the rows themselves: they are the past of the rows scored
    later, as if they stood in front of the series.
    """

    name = "forecast_interval"

    def __init__(self, context: int = 100, confidence: float = 0.95, trend_window: int = 20,
                 layout: Layout = DEFAULT):
        self.context, self.confidence, self.trend_window, self.layout = context, confidence, trend_window, layout

    def fit(self, rows: DataFrame) -> DataFrame:
        return rows.select(*ROW_KEY, "value")

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        indexed = with_index(rows, self.layout).select(*ROW_KEY, "value", "idx", F.lit(True).alias("current"))
        if params is not None:
            # only the last ``context`` rows of the past can matter
            past = with_index(params, self.layout)
            totals = past.groupBy("series_id").agg(F.count("*").alias("_past"))
            past = join_stats(past, totals).filter(F.col("idx") >= F.col("_past") - self.context).select(
                "series_id", F.timestamp_micros(F.lit(-(2 ** 60))).alias("ts"), F.col("idx").alias("seq"),
                "value", "idx", F.lit(False).alias("current"))
            indexed = join_stats(indexed, totals).withColumn("idx", F.col("idx") + F.coalesce("_past", F.lit(0)))
            indexed = indexed.drop("_past").unionByName(past)
        need = min(self.context, MIN_CONTEXT)
        indexed = shared(indexed, "indexed")
        around = _recent(indexed, self.context, self.trend_window, self.layout).filter("current")
        f = around.withColumn("f", trend_forecast(F.col("recent")))
        z = normal_quantile((1 + self.confidence) / 2)
        off = F.abs(F.col("value") - (F.col("f.level") + F.col("f.slope")))
        half = z * F.col("f.spread")
        enough = F.col("at") >= need
        f = f.select(*ROW_KEY, F.when(enough, off / F.greatest(half, F.lit(0.5e-10))).alias("score"),
                     F.when(enough, off > half).alias("is_anomaly"))
        return scored(rows.select(*ROW_KEY, "value").join(f, ROW_KEY, "left"), self.name,
                      F.col("score"), F.col("is_anomaly"))


def forecast_tail(rows: DataFrame, horizon: int, confidence: float = 0.95, trend_window: int = 20,
                  noise_scale: float = 0.0, seed: int = 42, layout: Layout = DEFAULT) -> DataFrame:
    """Extrapolate the recent trend of each series: ``(series_id, step, mean, lower, upper)``.

    ``noise_scale`` adds random noise of that many standard deviations (off by
    default).  Series without a value forecast 0.
    """
    tails = _tails(rows, trend_window, layout).select("series_id", trend_forecast(F.col("context")).alias("f"))
    tails = tails.select("series_id", "f.*")
    steps = tails.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    mean = F.col("level") + F.col("slope") * (F.col("step") + 1)
    if noise_scale:
        mean = mean + F.randn(seed) * noise_scale * F.col("spread")
    width = normal_quantile((1 + confidence) / 2) * F.col("spread") * F.sqrt(1 + F.col("step") / horizon)
    return (steps.withColumns({"mean": mean, "width": width})
            .select("series_id", "step", "mean", (F.col("mean") - F.col("width")).alias("lower"),
                    (F.col("mean") + F.col("width")).alias("upper")))


def _tails(rows: DataFrame, length: int, layout: Layout) -> DataFrame:
    """``(series_id, context)``: the last ``length`` values of every series, in order."""
    last = last_per_series(rows.filter("value is not null").select(*ROW_KEY, "value"), length, layout)
    last = last.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "value")))["value"].alias("context"))
    return rows.select("series_id").distinct().join(last, "series_id", "left").withColumn(
        "context", F.coalesce("context", F.array().cast("array<double>")))


Forecaster = Callable[[list, int, float], tuple]


def forecast_with(rows: DataFrame, forecaster: Forecaster, horizon: int, confidence: float = 0.95,
                  context: int = 100, layout: Layout = DEFAULT) -> DataFrame:
    """Plug-in point: ``forecaster(contexts, horizon, confidence) -> (mean, lower, upper)``.

    ``contexts`` is a list of arrays, one per series of the batch; each result has
    one row of ``horizon`` numbers per context.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mean, lower, upper = forecaster(list(batch["context"]), horizon, confidence)
            yield pd.DataFrame([
                (sid, step, float(m[step]), float(lo[step]), float(up[step]))
                for sid, m, lo, up in zip(batch["series_id"], mean, lower, upper) for step in range(horizon)],
                columns=["series_id", "step", "mean", "lower", "upper"])

    return _tails(rows, context, layout).mapInPandas(
        run, "series_id string, step int, mean double, lower double, upper double")
