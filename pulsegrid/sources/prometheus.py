"""Text exposition dumps, one sample per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.labels import literal_labels, merge_labels
from pulsegrid.schema import null_if_nan
from pulsegrid.sources.text import map_last_wins, number, pair

# The line and label patterns of the format.
LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)(?:\s+(\d+))?$'
LABEL = r'(\w+)="([^"]*)"'


def parse_exposition(lines: DataFrame, source: str | Column = "prometheus", column: str = "value",
                     labels: dict[str, str] | None = None, received: Column | None = None) -> DataFrame:
    """Metric rows from text lines; comments and unreadable lines are skipped.

    Times are milliseconds; a line without one gets ``received``.
    """
    text = F.trim(F.rtrim(F.col(column), F.lit("\r\n \t")))
    # one match per line: its groups, set apart by a character no line contains
    lines = lines.withColumn("_p", F.split(F.regexp_replace(text, LINE, "$1\u0001$2\u0001$3\u0001$4"), "\u0001"))
    part = lambda i: F.get("_p", F.lit(i - 1))
    value = number(part(3))
    found = lambda i: F.regexp_extract_all(part(2), F.lit(LABEL), F.lit(i))
    own = map_last_wins(F.zip_with(found(1), found(2), pair))
    stamp = F.timestamp_millis(F.nullif(part(4), F.lit("")).try_cast("bigint"))
    ok = (F.size("_p") == 4) & value.isNotNull()
    return lines.filter(ok).select(
        part(1).alias("name"), null_if_nan(value).alias("value"),
        F.coalesce(stamp, received if received is not None else F.current_timestamp()).alias("ts"),
        merge_labels(own, literal_labels(labels)).alias("labels"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit("").alias("unit"))


def read_exposition(spark: SparkSession, paths: str | list[str], labels: dict[str, str] | None = None,
                    received: Column | None = None) -> DataFrame:
    """All dumps under some paths; unreadable files are skipped, so one bad target does not stop the rest."""
    lines = (spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths)
             .select("value", F.col("_metadata.file_path").alias("file")))
    return parse_exposition(lines, F.col("file"), labels=labels, received=received)
