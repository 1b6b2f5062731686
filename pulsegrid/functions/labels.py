"""Label maps: merging, matching and order-free fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def merge_labels(base: Column, extra: Column) -> Column:
    """Union of two maps; ``extra`` wins on shared keys, NULL counts as empty."""
    none = F.create_map().cast("map<string,string>")
    base, extra = F.coalesce(base, none), F.coalesce(extra, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def literal_labels(labels: dict[str, str] | None) -> Column:
    flat = [F.lit(x) for kv in (labels or {}).items() for x in kv]
    return F.create_map(*flat).cast("map<string,string>")


def with_labels(df: DataFrame, extra: dict[str, str] | None) -> DataFrame:
    """Add labels to every row."""
    if not extra:
        return df
    return df.withColumn("labels", merge_labels(F.col("labels"), literal_labels(extra)))


def sorted_pairs(labels: Column) -> Column:
    """``k=v`` strings in key order."""
    entries = F.array_sort(F.map_entries(F.coalesce(labels, literal_labels(None))))
    return F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def label_fingerprint(name: Column, labels: Column) -> Column:
    """Readable series key, ``name{k=v,...}``."""
    return F.concat(name, F.lit("{"), F.array_join(sorted_pairs(labels), ","), F.lit("}"))


def alert_fingerprint(name: Column, labels: Column) -> Column:
    """16 hex digits that identify a metric and its labels."""
    text = F.array_join(F.concat(F.array(name), sorted_pairs(labels)), "|")
    return F.substring(F.sha2(text, 256), 1, 16)


def label_equals(labels: Column, key: str, value: str) -> Column:
    return F.coalesce(F.element_at(labels, F.lit(key)) == F.lit(value), F.lit(False))
