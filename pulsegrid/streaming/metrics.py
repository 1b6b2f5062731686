"""Metric streams: intake, grids, sliding statistics, scoring, suppression, counter deltas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.detectors.base import RowDetector
from pulsegrid.operators.maintenance import not_suppressed

from pulsegrid.sources.snmp import device_key, name_samples, sample_labels, source_name
from pulsegrid.sources.statsd import parse_statsd
from pulsegrid.streaming.ordered import Step, in_order


def statsd_intake(lines: DataFrame, received: Column | None = None) -> DataFrame:
    """A text stream as metric rows; each micro-batch is one flush of the buffer."""
    return parse_statsd(lines, received=received)


def resample_stream(rows: DataFrame, interval: str, watermark: str, method: str = "mean") -> DataFrame:
    """Even time bins per series, emitted once the watermark has passed them.

    Bins start at multiples of the interval.  Rows later than the watermark are
    dropped, and bins without rows do not appear.
    """
    v = F.col("value")
    order = F.when(v.isNotNull(), F.struct("ts", "seq"))
    aggs = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v), "sum": F.sum(v),
            "last": F.max_by(v, order), "first": F.min_by(v, order)}
    if method not in aggs:
        raise ValueError(f"unknown resampling method {method!r}, expected one of {sorted(aggs)}")
    return (rows.withWatermark("ts", watermark).groupBy("series_id", F.window("ts", interval).alias("bin"))
            .agg(aggs[method].alias("value"))
            .select("series_id", F.col("bin.start").alias("bin_start"), F.col("bin.end").alias("bin_end"), "value"))


def sliding_stats(rows: DataFrame, size: str, slide: str, watermark: str) -> DataFrame:
    """Count, mean and population sd per series over overlapping stretches of time."""
    v = F.col("value")
    return (rows.withWatermark("ts", watermark).groupBy("series_id", F.window("ts", size, slide).alias("span"))
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
            .select("series_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"),
                    "n", "mean", "sd"))


class _Sliding(Step):
    state = "recent array<double>"
    out = "series_id string, ts timestamp, seq bigint, value double, score double"

    def __init__(self, window: int):
        self.window = window

    def begin(self) -> tuple:
        return ([],)

    def rows(self, key: tuple, state: tuple, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        past = list(state[0])
        vals = pd.Series(past + frame["value"].tolist(), dtype="float64")
        roll = vals.rolling(self.window + 1, min_periods=1)
        sd = roll.std(ddof=0)
        z = ((vals - roll.mean()) / sd).abs().where(sd > 1e-12 * vals.abs().clip(lower=1.0), 0.0).fillna(0.0)
        out = pd.DataFrame({"series_id": frame["series_id"], "ts": pd.to_datetime(frame["us"], unit="us", utc=True),
                            "seq": frame["seq"], "value": frame["value"], "score": z.iloc[len(past):].to_numpy()})
        return ([None if x != x else float(x) for x in vals.tail(self.window)],), out


def sliding_scores(rows: DataFrame, window: int, watermark: str) -> DataFrame:
    """z-score of each row against itself and the ``window`` rows before it in event time.

    A row is scored when the watermark has passed it; the last ``window`` values of a series are kept as state.
    """
    return in_order(rows.select("series_id", "ts", "seq", "value"), "series_id", _Sliding(window), watermark)


def score_stream(rows: DataFrame, detector: RowDetector, params: DataFrame) -> DataFrame:
    """Score a stream with parameters fitted before."""
    return detector.detect(rows, params)


def suppress_stream(rows: DataFrame, windows: DataFrame, name: str = "series_id",
                    labels: str | None = None) -> DataFrame:
    """Drop rows that fall into a maintenance window."""
    return not_suppressed(rows, windows, name, labels)


def suppress_each_batch(read_windows: Callable[[], DataFrame], then: Callable[[DataFrame, int], None],
                        name: str = "series_id", labels: str | None = None) -> Callable[[DataFrame, int], None]:
    """The same for ``foreachBatch``, with the windows read anew for every micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        then(not_suppressed(batch, read_windows(), name, labels), batch_id)
    return each


class _Counter(Step):
    state = "last double"
    out = "name string, value double, ts timestamp, labels string, source string, unit string, seq bigint"

    def __init__(self, span: float):
        self.span = span

    def begin(self) -> tuple:
        return (None,)

    def rows(self, key: tuple, state: tuple, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        value = frame["value"]
        before = value.shift(1)
        if state[0] is not None:
            before.iloc[0] = state[0]
        rise = value - before
        delta = before.notna() & frame["name"].str.contains("Octets", regex=False)
        out = frame[["name", "value", "us", "labels", "source", "unit", "seq"]].rename(columns={"us": "ts"})
        out["ts"] = pd.to_datetime(out["ts"], unit="us", utc=True)
        out["value"] = value.where(~delta, rise.where(rise >= 0, self.span - before + value))
        out["name"] = out["name"].where(~delta, out["name"] + "_delta")
        return (float(value.iloc[-1]),), out


def counter_stream(samples: DataFrame, watermark: str, bits: int = 64, strict_parity: bool = False) -> DataFrame:
    """Polled device samples as metrics, octet counters as increases between polls.

    Polls of a counter are taken in event-time order when the watermark has passed them, so a poll that comes late inside
    it is no wrap, and the result does not depend on where files and micro-batches are cut.
    """
    named = name_samples(samples, strict_parity=strict_parity).select(
        device_key(strict_parity).alias("device"), F.col("value").cast("double").alias("value"), "ts", "seq", "name",
        F.to_json(sample_labels()).alias("labels"), source_name().alias("source"), "unit")
    step = _Counter(float(2 ** (64 if bits == 64 else 32)))
    return in_order(named, "device", step, watermark).withColumn("labels", F.from_json("labels", "map<string,string>"))
