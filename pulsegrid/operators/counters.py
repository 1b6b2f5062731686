"""Counters: wrap-aware differences and wrap positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.scalar import wrap_delta
from pulsegrid.operators.ordering import DEFAULT, Layout, with_neighbour


def unwrap_counters(rows: DataFrame, bits: int = 64, max_rate: float | None = None,
                    only: Column | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """Replace ``value`` by its increase since the previous row.

    The first row is 0, an increase above ``max_rate`` is a reset and becomes 0,
    and a missing neighbour gives a missing increase.  ``only`` limits this to
    some rows, e.g. those whose name says they are counters.
    """
    rows = with_neighbour(rows, ["seq", "value"], layout=layout)
    delta = wrap_delta(F.col("value"), F.col("prev_value"), bits)
    if max_rate is not None:
        delta = F.when(delta > max_rate, F.lit(0.0)).otherwise(delta)
    delta = F.when(F.col("prev_seq").isNull(), F.lit(0.0)).otherwise(delta)
    if only is not None:
        delta = F.when(only, delta).otherwise(F.col("value"))
    return rows.withColumn("value", delta).drop("prev_seq", "prev_value")


def counter_wraps(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``wrapped``: the value is below the previous one."""
    rows = with_neighbour(rows, ["value"], layout=layout)
    return (rows.withColumn("wrapped", F.coalesce(F.col("value") < F.col("prev_value"), F.lit(False)))
            .drop("prev_value"))
