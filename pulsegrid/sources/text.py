"""Column helpers shared by the text formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what counts as a decimal number.  Spark's cast alone would also
# accept type suffixes such as "1d".
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Text to DOUBLE, NULL if it is no number; infinities and nan by their usual names."""
    t = F.lower(F.trim(text))
    return (F.when(t.rlike(NUMBER), t.try_cast("double"))
            .when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
            .when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
            .when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan"))))


def map_last_wins(entries: Column) -> Column:
    """Array of (key, value) structs to a map; of equal keys the last one counts."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(entries, empty, lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))
