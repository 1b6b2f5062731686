"""Consensus of several detectors."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.detectors.base import Detector, RowDetector, defined
from pulsegrid.operators.stats import join_stats
from pulsegrid.schema import ROW_KEY, safe_div

STRATEGIES = ("majority", "unanimous", "any", "weighted", "threshold")


def vote(strategy: str, votes: Column, weighted: Column, count: int, weight: float,
         threshold: float = 0.5) -> Column:
    """Whether the votes make a row an anomaly."""
    rules = {"majority": votes > count / 2, "unanimous": votes == count, "any": votes > 0,
             "weighted": weighted > weight / 2, "threshold": votes / F.lit(count) >= threshold}
    if strategy not in rules:
        raise ValueError(f"unknown voting strategy {strategy!r}, expected one of {STRATEGIES}")
    return rules[strategy]


class Ensemble(Detector):
    """Votes of several detectors, and the weighted mean of their scores.

    Each detector's scores are first divided by their largest in the series.
    Row detectors are evaluated as columns of the same row: with only those, a
    run is one aggregate, one small join and a projection.  Other detectors
    bring their own score rows, which are pivoted by row key in one shuffle.
    A failing detector fails the run.
    """

    name = "ensemble"

    def __init__(self, detectors: list[Detector], strategy: str = "majority", threshold: float = 0.5,
                 weights: Mapping[str, float] | None = None):
        self.detectors, self.strategy, self.threshold = list(detectors), strategy, threshold
        self.weights = dict(weights or {})
        vote(strategy, F.lit(0), F.lit(0.0), 1, 1.0)

    def weight(self, d: Detector) -> float:
        return float(self.weights.get(d.name, 1.0))

    def fit(self, rows: DataFrame) -> list[DataFrame | None]:
        return [d.fit(rows) for d in self.detectors]

    def scores(self, rows: DataFrame, params: list[DataFrame | None] | None = None) -> DataFrame:
        """Long score table of all detectors."""
        params = params or self.fit(rows)
        parts = [d.detect(rows, p) for d, p in zip(self.detectors, params)]
        return reduce(DataFrame.unionByName, parts)

    def detect(self, rows: DataFrame, params: list[DataFrame | None] | None = None,
               keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows with ``score, is_anomaly, votes, detectors`` and the columns in ``keep``."""
        if not self.detectors:
            return rows.select(*ROW_KEY, "value", *keep, F.lit(self.name).alias("detector"), F.lit(0.0).alias("score"),
                               F.lit(False).alias("is_anomaly"), F.lit(0).alias("votes"),
                               F.array().cast("array<string>").alias("detectors"))
        params = params or self.fit(rows)
        numbered = list(enumerate(zip(self.detectors, params)))
        byrow = [(i, d, p) for i, (d, p) in numbered if isinstance(d, RowDetector)]
        other = [(i, d, p) for i, (d, p) in numbered if not isinstance(d, RowDetector)]
        wide = rows.select(*ROW_KEY, "value", *keep)
        if other:
            wide = wide.join(self._pivoted(rows, other), ROW_KEY, "left")
        wide = self._by_row(wide, rows, byrow) if byrow else wide
        measured = [i for i, _, _ in other] + [i for i, d, _ in byrow if not d.outward]
        if measured:
            peaks = wide.groupBy("series_id").agg(*[F.max(f"s{i}").alias(f"top{i}") for i in measured])
            wide = join_stats(wide, peaks)
        return self._combined(wide, keep)

    def _by_row(self, wide: DataFrame, rows: DataFrame, byrow: list) -> DataFrame:
        fitted = rows.groupBy("series_id").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
        for i, _, p in byrow:
            fields = [c for c in p.columns if c != "series_id"]
            fitted = fitted.join(p.select("series_id", F.struct(*fields).alias(f"p{i}")), "series_id", "left")

        def score(i: int, d: RowDetector, v: Column) -> Column:
            return defined(d.score(v, lambda x: F.col(f"p{i}.{x}")))

        fitted = fitted.withColumns({
            f"top{i}": F.greatest(score(i, d, F.col("vmin")), score(i, d, F.col("vmax")))
            for i, d, _ in byrow if d.outward}).drop("vmin", "vmax")
        wide = join_stats(wide, fitted).withColumns({f"s{i}": score(i, d, F.col("value")) for i, d, _ in byrow})
        wide = wide.withColumns({f"f{i}": F.coalesce(d.flag(F.col(f"s{i}")), F.lit(False)) for i, d, _ in byrow})
        return wide.drop(*[f"p{i}" for i, _, _ in byrow])

    def _pivoted(self, rows: DataFrame, other: list) -> DataFrame:
        parts = [d.detect(rows, p).select(*ROW_KEY, F.lit(i).alias("which"), "score", "is_anomaly")
                 for i, d, p in other]
        tall = reduce(DataFrame.unionByName, parts)
        which = F.col("which")
        return tall.groupBy(*ROW_KEY).agg(
            *[F.max(F.when(which == i, F.col("score"))).alias(f"s{i}") for i, _, _ in other],
            *[F.max(F.when(which == i, F.col("is_anomaly"))).alias(f"f{i}") for i, _, _ in other])

    def _combined(self, wide: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        total = sum(self.weight(d) for d in self.detectors)
        share, votes, weighted = F.lit(0.0), F.lit(0), F.lit(0.0)
        for i, d in enumerate(self.detectors):
            w, s, top = self.weight(d), F.col(f"s{i}"), F.col(f"top{i}")
            share = share + w * defined(F.when(top > 0, safe_div(s, top)).otherwise(s))
            votes = votes + F.col(f"f{i}").cast("int")
            weighted = weighted + w * F.col(f"f{i}").cast("int")
        score = share / F.lit(total) if total > 0 else share
        names = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(d.name))
                                          for i, d in enumerate(self.detectors)]))
        flag = vote(self.strategy, votes, weighted, len(self.detectors), total, self.threshold)
        return wide.select(*ROW_KEY, "value", *keep, F.lit(self.name).alias("detector"), score.alias("score"),
                           flag.alias("is_anomaly"), votes.alias("votes"), names.alias("detectors"))


def detector_summary(scores: DataFrame) -> DataFrame:
    """Anomalies, ratio and largest score per series and detector."""
    hit = F.col("is_anomaly").cast("int")
    return scores.groupBy("series_id", "detector").agg(
        F.count("*").alias("points"), F.sum(hit).alias("anomaly_count"),
        F.avg(hit).alias("anomaly_ratio"), F.max("score").alias("max_score"))
