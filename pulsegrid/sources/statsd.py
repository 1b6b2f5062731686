"""StatsD text lines: ``name:value|type[|@rate][|#tag:value,...]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.labels import literal_labels, merge_labels
from pulsegrid.schema import null_if_nan
from pulsegrid.sources.text import map_last_wins, number, pair

# Type codes and their names.
TYPES = {"c": "counter", "g": "gauge", "ms": "timer", "s": "set", "h": "histogram"}


def _after_colon(text: Column) -> Column:
    return F.substr(text, F.instr(text, ":") + 1)


def parse_statsd(lines: DataFrame, column: str = "value", received: Column | None = None,
                 labels: dict[str, str] | None = None) -> DataFrame:
    """Metric rows; the type and the tags become labels, counters are scaled by their sample rate."""
    text = F.trim(F.col(column))
    fields = F.split(_after_colon(text), r"\|")
    value = number(F.get(fields, F.lit(0)))
    code = F.trim(F.get(fields, F.lit(1)))
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kind = F.coalesce(F.element_at(names, code), code)
    extras = F.transform(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), lambda e: F.trim(e))
    rates = F.filter(F.transform(F.filter(extras, lambda e: F.startswith(e, F.lit("@"))),
                                 lambda e: number(F.substr(e, F.lit(2)))), lambda r: r.isNotNull())
    rate = F.coalesce(F.get(rates, F.size(rates) - 1), F.lit(1.0))
    tags = F.flatten(F.transform(F.filter(extras, lambda e: F.startswith(e, F.lit("#"))),
                                 lambda e: F.split(F.substr(e, F.lit(2)), ",")))
    entries = F.transform(tags, lambda t: F.when(
        F.contains(t, F.lit(":")),
        pair(F.trim(F.substring_index(t, ":", 1)), F.trim(_after_colon(t))))
        .otherwise(pair(F.trim(t), F.lit("true"))))
    own = map_last_wins(F.concat(F.array(pair(F.lit("type"), kind)), entries))
    scaled = F.when((kind == "counter") & (rate > 0) & (rate != 1.0), F.try_divide(value, rate)).otherwise(value)
    ok = F.contains(text, F.lit(":")) & (F.size(fields) >= 2) & value.isNotNull()
    return lines.filter(ok).select(
        F.trim(F.substring_index(text, ":", 1)).alias("name"), null_if_nan(scaled).alias("value"),
        (received if received is not None else F.current_timestamp()).alias("ts"),
        merge_labels(own, literal_labels(labels)).alias("labels"),
        F.lit("statsd").alias("source"), F.lit("").alias("unit"))


def read_statsd(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return parse_statsd(spark.read.text(paths), **options)
