"""Gaps: finding missing stretches and filling missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.ordering import DEFAULT, Layout, with_around, with_latest, with_neighbour
from pulsegrid.operators.stats import join_stats, quantiles, steps
from pulsegrid.schema import micros
from pulsegrid.session import shared


def detect_gaps(rows: DataFrame, expected_interval: float | None = None, tolerance: float = 1.5,
                layout: Layout = DEFAULT) -> DataFrame:
    """Steps longer than ``tolerance`` times the expected interval (default: the median step)."""
    stepped = shared(steps(rows, index=True, layout=layout).select("series_id", "idx", "dt"), "steps")
    if expected_interval is None:
        stepped = join_stats(stepped, quantiles(stepped, {"interval": 0.5}, "dt").drop("n"))
    else:
        stepped = stepped.withColumn("interval", F.lit(float(expected_interval)))
    return (stepped.filter(F.col("dt") > F.col("interval") * tolerance)
            .select("series_id", (F.col("idx") - 1).alias("start_idx"),
                    F.col("idx").alias("end_idx"), F.col("dt").alias("duration")))


def fill_gaps(rows: DataFrame, method: str = "linear", max_gap: float | None = None,
              layout: Layout = DEFAULT) -> DataFrame:
    """Replace missing values: ``linear`` (also for unknown names), ``ffill``, ``bfill`` or ``zero``.

    ``max_gap`` is in seconds.  For the directional fills it limits the step
    between adjacent rows; for linear the distance between the valid rows on
    both sides (on the left side only, for a missing tail; a missing head then
    stays missing).
    """
    if method == "zero":
        return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if method in ("ffill", "bfill"):
        return _directional(rows, method == "bfill", max_gap, layout)
    return _linear(rows, max_gap, layout)


def _directional(rows: DataFrame, backward: bool, max_gap: float | None, layout: Layout) -> DataFrame:
    # a valid value feeds the rows after it until a step wider than max_gap: both
    # are markers, and a marker without a value ends the fill
    marker: Column = F.col("value").isNotNull()
    if max_gap is not None:
        rows = with_neighbour(rows, ["ts"], "near", forward=backward, layout=layout)
        step = F.abs(micros(F.col("ts")) - micros(F.col("near_ts")))
        marker = marker | F.coalesce(step > max_gap * 1e6, F.lit(False))
    filled = with_latest(rows, marker, ["value"], "_src", forward=backward, layout=layout)
    return (filled.withColumn("value", F.coalesce("value", F.col("_src.value")))
            .drop("_src", "near_ts"))


def _linear(rows: DataFrame, max_gap: float | None, layout: Layout) -> DataFrame:
    valid = F.col("value").isNotNull()
    rows = with_around(rows, valid, ["ts", "value"], "_left", "_right", "_valid", layout)
    t, lt, rt = (micros(F.col(c)) for c in ("ts", "_left.ts", "_right.ts"))
    lv, rv = F.col("_left.value"), F.col("_right.value")
    inner = F.when(rt == lt, lv).otherwise(lv + (rv - lv) * F.try_divide(t - lt, rt - lt))
    both = lt.isNotNull() & rt.isNotNull()
    if max_gap is None:
        guess = F.when(both, inner).otherwise(F.coalesce(lv, rv))
    else:
        limit = F.lit(max_gap * 1e6)
        guess = (F.when(both & (rt - lt <= limit), inner)
                 .when(rt.isNull() & (t - lt <= limit), lv))
    # a series with a single valid value has nothing to interpolate between
    guess = F.when(F.col("_valid") >= 2, guess)
    return (rows.withColumn("value", F.when(valid, F.col("value")).otherwise(guess))
            .drop("_left", "_right", "_valid"))
