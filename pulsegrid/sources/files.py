"""CSV and JSON metric files, singly or by the folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.labels import literal_labels, merge_labels
from pulsegrid.schema import METRIC_SCHEMA, from_seconds, null_if_nan
from pulsegrid.sources.documents import array_entries
from pulsegrid.sources.text import number, pair

_FIELDS = {"name": "string", "value": "string", "timestamp": "string", "labels": "map<string,string>", "unit": "string"}
_ENTRY = "struct<" + ",".join(f"{k}:{t}" for k, t in _FIELDS.items()) + ">"
_LINE = ", ".join(f"{k} {t}" for k, t in _FIELDS.items()) + f", metrics array<{_ENTRY}>"
_DOCUMENT = f"struct<metrics:array<{_ENTRY}>>"


def _metric(name: Column, value: Column, ts: Column, labels: Column, source: Column, unit: Column) -> list[Column]:
    cols = [name, null_if_nan(value), ts, labels, source, unit]
    return [c.cast(f.dataType).alias(f.name) for c, f in zip(cols, METRIC_SCHEMA.fields)]


def _when(text: Column, received: Column | None) -> Column:
    """Epoch seconds; the time of receipt if absent or unreadable."""
    got = number(text)
    return F.when(got.isNotNull() & ~F.isnan(got), from_seconds(got)).otherwise(
        received if received is not None else F.current_timestamp())


def _header_groups(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """Files by their first line; one scan of the text, a row per file after partial aggregation."""
    meta = F.col("_metadata")
    lines = (spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), "value",
                                          F.monotonically_increasing_id().alias("k"))
             .filter((F.col("at") == 0) & (F.trim("value") != "")))
    first = lines.groupBy("file").agg(F.min_by("value", "k").alias("header"))
    return [r.files for r in first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
            .orderBy("header").collect()]


def read_csv(spark: SparkSession, path: str | list[str], name_col: str = "name", value_col: str = "value",
             timestamp_col: str = "timestamp", delimiter: str = ",", labels: dict[str, str] | None = None,
             received: Column | None = None, rejects: bool = False, same_header: bool = False,
             multiline: bool = False) -> DataFrame:
    """Metric rows from CSV with a header; the other non-empty columns become labels.

    Every file is read by its own header, which takes one more scan of the first
    lines; ``same_header`` promises that all are alike and saves it.  Quotes are
    doubled inside quoted fields.  ``multiline`` allows line breaks in them, at
    the price of one task per file.  Rows without a numeric value are skipped;
    ``rejects`` returns those instead.
    """
    groups = [path] if same_header else _header_groups(spark, path) or [path]
    options = {"header": True, "sep": delimiter, "escape": '"', "multiLine": multiline}
    parts = []
    for files in groups:
        raw = spark.read.options(**options).csv(files)
        missing = {name_col, value_col} - set(raw.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} not in {files}")
        parts.append(_csv_rows(raw, name_col, value_col, timestamp_col, labels, received, rejects))
    return union_metrics(*parts)


def _csv_rows(raw: DataFrame, name_col: str, value_col: str, timestamp_col: str, labels: dict[str, str] | None,
              received: Column | None, rejects: bool) -> DataFrame:
    value = number(F.col(f"`{value_col}`"))
    if rejects:
        return raw.filter(value.isNull())
    rest = [c for c in raw.columns if c not in (name_col, value_col, timestamp_col)]
    own = F.array(*[pair(F.lit(c), F.col(f"`{c}`")) for c in rest]).cast("array<struct<key:string,value:string>>")
    own = F.map_from_entries(F.filter(own, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    ts = F.col(f"`{timestamp_col}`") if timestamp_col in raw.columns else F.lit(None).cast("string")
    return raw.filter(value.isNotNull()).select(*_metric(
        F.col(f"`{name_col}`"), value, _when(ts, received), merge_labels(literal_labels(labels), own),
        F.col("_metadata.file_path"), F.lit("")))


def read_json(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None,
              received: Column | None = None, lines: bool = False, rejects: bool = False, split: bool = False) -> DataFrame:
    """Metric rows from documents that are a JSON array of entries, or an object whose ``metrics`` is one.

    A document that is neither, or not JSON, stops the read; ``rejects`` returns
    ``(file, reason)`` of those instead.  ``lines`` reads one entry, or one such
    object, per line, which large files should use because they can then be
    split.  ``split`` divides large documents too, over as many tasks as they have blocks; they must be arrays, and it
    costs three shuffles of the text.  Entries without a name or a numeric value are skipped.
    """
    if split:
        if lines or rejects:
            raise ValueError("split documents are neither lines nor listed as rejects")
        entries = array_entries(spark, path, _ENTRY)
    elif lines:
        raw = spark.read.schema(_LINE).json(path).withColumn("file", F.col("_metadata.file_path"))
        single = F.array(F.struct("name", "value", "timestamp", "labels", "unit"))
        entries = raw.select("file", F.explode(F.coalesce("metrics", single)).alias("e"))
    else:
        text = F.col("value")
        opening = F.regexp_extract(text, r"^\s*(.)", 1)
        reason = (F.when(F.get_json_object(text, "$").isNull(), "not a JSON document")
                  .when(~opening.isin("[", "{"), "neither a list nor an object"))
        raw = (spark.read.text(path, wholetext=True)
               .select(F.col("_metadata.file_path").alias("file"), "value", reason.alias("reason")))
        if rejects:
            return raw.filter(F.col("reason").isNotNull()).select("file", "reason")
        sound = F.when(F.col("reason").isNull(), True).otherwise(
            F.raise_error(F.concat_ws(": ", "file", "reason")).cast("boolean"))
        listed = F.when(opening == "[", F.from_json(text, f"array<{_ENTRY}>")).otherwise(
            F.from_json(text, _DOCUMENT)["metrics"])
        entries = raw.filter(sound).select("file", F.explode(listed).alias("e"))
    value = number(F.col("e.value"))
    return (entries.filter(F.col("e.name").isNotNull() & value.isNotNull())
            .select(*_metric(F.col("e.name"), value, _when(F.col("e.timestamp"), received),
                             merge_labels(literal_labels(labels), F.col("e.labels")), F.col("file"),
                             F.coalesce(F.col("e.unit"), F.lit("")))))


def read_metrics(spark: SparkSession, path: str, format: str = "auto", **options) -> DataFrame:
    """Read by format, or by the file name's suffix."""
    kind = format
    if kind == "auto":
        kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "json":
        return read_json(spark, path, **options)
    raise ValueError(f"unsupported file format {kind!r} (expected csv or json)")


def union_metrics(*batches: DataFrame) -> DataFrame:
    """All rows of several batches."""
    first, *rest = batches
    for b in rest:
        first = first.unionByName(b, allowMissingColumns=True)
    return first
