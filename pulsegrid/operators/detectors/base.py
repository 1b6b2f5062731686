"""What a detector is.

``fit`` learns one small row per series; ``detect`` turns series rows into score
rows ``(series_id, ts, seq, value, detector, score, is_anomaly)``.  The fitted
table is an ordinary DataFrame: write it, read it back, apply it to other rows
or to a stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.schema import ROW_KEY

SCORE_COLUMNS = [*ROW_KEY, "value", "detector", "score", "is_anomaly"]


def defined(score: Column) -> Column:
    """The score, or 0 if it is missing or NaN, which Spark would order above every number."""
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))


def scored(rows: DataFrame, name: str, score: Column, flag: Column) -> DataFrame:
    """Score rows; a missing or undefined score is 0 and is never an anomaly."""
    return rows.select(*ROW_KEY, "value", F.lit(name).alias("detector"), defined(score).alias("score"),
                       F.coalesce(flag & ~F.isnan(score), F.lit(False)).alias("is_anomaly"))


class Detector:
    """Base class; subclasses may keep nothing (``fit`` returning None)."""

    name = "detector"

    def fit(self, rows: DataFrame) -> DataFrame | None:
        return None

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def fit_detect(self, rows: DataFrame) -> DataFrame:
        return self.detect(rows, self.fit(rows))


class RowDetector(Detector):
    """A detector whose score needs only the value and the fitted row.

    Such detectors are columns, so several of them, and streams, run without a
    shuffle of the rows.
    """

    #: Scores grow away from the centre, so the extreme values of a series have its largest score.
    outward = False

    def score(self, value: Column, params: Callable[[str], Column]) -> Column:
        """Score of a value; ``params(x)`` is the fitted column ``x``."""
        raise NotImplementedError

    def flag(self, score: Column) -> Column:
        raise NotImplementedError

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        from pulsegrid.operators.stats import join_stats

        fitted = params.select("series_id", F.struct(
            *[c for c in params.columns if c != "series_id"]).alias("_p"))
        joined = join_stats(rows, fitted)
        s = defined(self.score(F.col("value"), lambda x: F.col(f"_p.{x}")))
        return scored(joined.withColumn("_s", s), self.name, F.col("_s"), self.flag(F.col("_s")))


class PandasDetector(Detector):
    """Plug-in point: ``fn(pdf) -> (scores, flags)`` over one stretch of one series.

    The series is cut into blocks of consecutive rows with ``context`` earlier
    rows in front, so ``fn`` sees bounded frames; context rows are not reported.
    """

    def __init__(self, name: str, fn: Callable[[pd.DataFrame], tuple], context: int = 0, layout=None):
        self.name, self.fn, self.context, self.layout = name, fn, context, layout

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        from pulsegrid.operators.ordering import DEFAULT, with_blocks, with_index

        layout = self.layout or DEFAULT
        fn = self.fn
        blocks = with_blocks(with_index(rows, layout), self.context, 0, layout).select(
            *ROW_KEY, "value", "idx", "block", "own")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx", ignore_index=True)
            pdf["score"], pdf["is_anomaly"] = fn(pdf)
            return pdf.loc[pdf["own"], [*ROW_KEY, "value", "score", "is_anomaly"]]

        out = blocks.groupBy("series_id", "block").applyInPandas(
            run, "series_id string, ts timestamp, seq bigint, value double, score double, is_anomaly boolean")
        return scored(out, self.name, F.col("score"), F.col("is_anomaly"))
