"""Statistical detectors: z-score, quartile fences, extreme deviates, seasonal residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.distributions import t_quantile
from pulsegrid.operators.detectors.base import Detector, RowDetector, defined, scored
from pulsegrid.operators.ordering import DEFAULT, Layout, framed, smallest_per_series, with_index
from pulsegrid.operators.seasonal import seasonal_decompose
from pulsegrid.operators.stats import guarded, join_stats, moments, quantiles
from pulsegrid.schema import ROW_KEY, safe_div
from pulsegrid.session import shared


class ZScore(RowDetector):
    """|value - mean| / sd above a threshold, over the fitted rows."""

    name = "zscore"
    outward = True

    def __init__(self, threshold: float = 3.0):
        self.threshold = threshold

    def fit(self, rows: DataFrame) -> DataFrame:
        return moments(rows).select("series_id", "n", "mean", guarded(F.col("sd")).alias("sd"))

    def score(self, value, params):
        return F.abs(value - F.coalesce(params("mean"), F.lit(0.0))) / guarded(params("sd"))

    def flag(self, score):
        return score > self.threshold


class SlidingZScore(Detector):
    """z-score against the row itself and the ``window`` rows before it.

    Series no longer than the window are scored against the fitted rows.
    """

    name = "zscore"

    def __init__(self, window: int, threshold: float = 3.0, layout: Layout = DEFAULT):
        self.window, self.layout, self.overall = window, layout, ZScore(threshold)

    def fit(self, rows: DataFrame) -> DataFrame:
        return self.overall.fit(rows)

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        w = self.window
        if params is None:
            params = self.fit(rows)
        stats = (rows.groupBy("series_id").agg(F.count("*").alias("_rows"))
                 .join(params.select("series_id", "mean", "sd"), "series_id", "left"))
        v = F.col("value")
        near = framed(rows, w, 0, lambda win: {
            "_c": F.count(v).over(win.rowsBetween(-w, 0)),
            "_m": F.avg(v).over(win.rowsBetween(-w, 0)),
            "_s": F.stddev_pop(v).over(win.rowsBetween(-w, 0))}, self.layout)
        near = join_stats(near, stats)
        local = F.when(F.col("_c") > 1, F.abs(safe_div(v - F.col("_m"), F.col("_s"))))
        score = F.when(F.col("_rows") > w, local).otherwise(self.overall.score(v, F.col))
        near = near.withColumn("_z", defined(score))
        return scored(near, self.name, F.col("_z"), self.overall.flag(F.col("_z")))


class Iqr(RowDetector):
    """Distance outside the quartile fences, in interquartile ranges."""

    name = "iqr"
    outward = True

    def __init__(self, factor: float = 1.5):
        self.factor = factor

    def fit(self, rows: DataFrame) -> DataFrame:
        q = quantiles(rows, {"q1": 0.25, "q3": 0.75})
        enough = F.col("n") >= 4
        low = F.when(enough, F.col("q1")).otherwise(F.lit(0.0))
        iqr = guarded(F.when(enough, F.col("q3") - F.col("q1")))
        high = F.when(enough, F.col("q3")).otherwise(F.lit(0.0))
        return q.select("series_id", (low - self.factor * iqr).alias("lower_fence"),
                        (high + self.factor * iqr).alias("upper_fence"), iqr.alias("iqr"))

    def score(self, value, params):
        below = F.coalesce(params("lower_fence"), F.lit(-self.factor)) - value
        above = value - F.coalesce(params("upper_fence"), F.lit(self.factor))
        return F.when(value.isNotNull(), F.greatest(below, above, F.lit(0.0)) / guarded(params("iqr")))

    def flag(self, score):
        return score > 0


class Gesd(Detector):
    """Generalised extreme studentised deviate test.

    Each round tests the value farthest from the mean, which is always the
    smallest or largest one left.  So one aggregate and the few extremes of each
    end decide the rounds; the rows themselves are scanned, never gathered.
    """

    name = "gesd"

    def __init__(self, max_anomalies: int = 10, alpha: float = 0.05, layout: Layout = DEFAULT):
        self.max_anomalies, self.alpha, self.layout = max_anomalies, alpha, layout

    def rounds(self, rows: DataFrame) -> DataFrame:
        """One row per round: the tested row, its statistic and critical value."""
        k = self.max_anomalies
        valid = with_index(rows, self.layout).filter("value is not null").select(
            "series_id", "idx", "value")
        ends = smallest_per_series(valid, k, F.asc("value"), F.asc("idx")).unionByName(
            smallest_per_series(valid, k, F.desc("value"), F.asc("idx"))).drop("rank").distinct()
        ends = ends.groupBy("series_id").agg(F.collect_list(F.struct("idx", "value")).alias("ends"))
        state = moments(valid).select("series_id", "n", "mean", "sd").join(ends, "series_id")
        limit, alpha = k, self.alpha

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [r for row in batch.itertuples(index=False) for r in _gesd_rounds(row, limit, alpha)]
                yield pd.DataFrame(found, columns=["series_id", "idx", "score", "critical", "is_anomaly"])

        return state.mapInPandas(
            run, "series_id string, idx bigint, score double, critical double, is_anomaly boolean")

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        indexed = shared(with_index(rows, self.layout).select(*ROW_KEY, "value", "idx"), "indexed")
        tested = self.rounds(indexed).select("series_id", "idx", "score", "is_anomaly")
        joined = join_stats(indexed, tested, ["series_id", "idx"])
        return scored(joined, self.name, F.col("score"), F.col("is_anomaly"))


def _gesd_rounds(row, limit: int, alpha: float) -> list[tuple]:
    """Rounds for one series from its moments and extreme values."""
    left = sorted((e["idx"], e["value"]) for e in row.ends)
    n, centre = int(row.n), float(row.mean)
    total, squares = 0.0, n * float(row.sd) ** 2      # of deviations from the first mean
    out: list[tuple] = []
    for k in range(1, min(limit, n // 2) + 1):
        if n < 3:
            break
        mean = centre + total / n
        var = max(squares - total * total / n, 0.0) / (n - 1)
        if var == 0:
            break
        at = max(range(len(left)), key=lambda i: (abs(left[i][1] - mean), -left[i][0]))
        idx, value = left[at]
        stat = abs(value - mean) / var ** 0.5
        p = min(max(1.0 - alpha / (2.0 * (n - k + 1)), 0.5), 0.9999)
        t = t_quantile(p, max(1, n - k - 1))
        critical = (n - k) * t / np.sqrt((n - k - 1 + t * t) * (n - k + 1))
        out.append((row.series_id, idx, stat, float(critical), bool(stat > critical)))
        if not stat > critical:
            break
        left.pop(at)
        n, total, squares = n - 1, total - (value - centre), squares - (value - centre) ** 2
    return out


class SeasonalResidual(Detector):
    """z-score of what trend and season leave unexplained."""

    name = "stl"

    def __init__(self, period: int | None = None, threshold: float = 3.0, layout: Layout = DEFAULT):
        self.period, self.threshold, self.layout = period, threshold, layout

    def _parts(self, rows: DataFrame, period) -> DataFrame:
        return shared(seasonal_decompose(rows, period, layout=self.layout)
                      .select(*ROW_KEY, "value", "period", "residual"), "residuals")

    def _stats(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("series_id").agg(
            F.first("period").alias("period"), F.avg("residual").alias("residual_mean"),
            guarded(F.stddev_pop("residual")).alias("residual_sd"))

    def _score(self, parts: DataFrame, params: DataFrame) -> DataFrame:
        parts = join_stats(parts, params.drop("period"))
        z = F.abs((F.col("residual") - F.coalesce(F.col("residual_mean"), F.lit(0.0)))
                  / guarded(F.col("residual_sd")))
        return scored(parts, self.name, z, z > self.threshold)

    def fit(self, rows: DataFrame) -> DataFrame:
        """period, mean and sd of the residual per series."""
        return self._stats(self._parts(rows, self.period))

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        if params is None:
            return self.fit_detect(rows)
        return self._score(self._parts(rows, self.period or params.select("series_id", "period")), params)

    def fit_detect(self, rows: DataFrame) -> DataFrame:
        parts = self._parts(rows, self.period)
        return self._score(parts, self._stats(parts))
