"""Polled device samples ``(host, port, oid, value, ts, labels)`` as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.labels import merge_labels
from pulsegrid.functions.scalar import wrap_delta
from pulsegrid.operators.ordering import DEFAULT, Layout, with_neighbour
from pulsegrid.schema import null_if_nan
from pulsegrid.session import sized

# Object identifier, metric name, unit.
OIDS = [
    ("1.3.6.1.2.1.1.3.0", "sysUpTime", "ticks"),
    ("1.3.6.1.2.1.2.2.1.10", "ifInOctets", "bytes"),
    ("1.3.6.1.2.1.2.2.1.16", "ifOutOctets", "bytes"),
    ("1.3.6.1.2.1.2.2.1.14", "ifInErrors", "errors"),
    ("1.3.6.1.2.1.2.2.1.20", "ifOutErrors", "errors"),
    ("1.3.6.1.2.1.25.3.3.1.2", "hrProcessorLoad", "percent"),
    ("1.3.6.1.2.1.25.2.3.1.6", "hrStorageUsed", "units"),
    ("1.3.6.1.4.1.2021.11.9.0", "ssCpuUser", "percent"),
    ("1.3.6.1.4.1.2021.11.10.0", "ssCpuSystem", "percent"),
    ("1.3.6.1.4.1.2021.11.11.0", "ssCpuIdle", "percent"),
    ("1.3.6.1.4.1.2021.4.5.0", "memTotalReal", "kB"),
    ("1.3.6.1.4.1.2021.4.6.0", "memAvailReal", "kB"),
]


def oid_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OIDS, "known string, oid_name string, oid_unit string")


def base_oid(oid: Column) -> Column:
    """The identifier without its last component."""
    return F.regexp_replace(oid, r"\.[^.]*$", "")


def name_samples(samples: DataFrame, names: DataFrame | None = None, strict_parity: bool = False) -> DataFrame:
    """Add ``name`` and ``unit``: by base identifier, else by the whole one, else the raw text.

    ``strict_parity`` looks up base identifiers only, so scalars whose known
    form ends in ``.0`` keep their raw identifier.
    """
    # the built-in dictionary is twelve rows; the size of another one is checked
    table = F.broadcast(oid_names(samples.sparkSession)) if names is None else sized(names, "oids")
    by_base = table.select(F.col("known").alias("_base"), F.col("oid_name").alias("_n1"), F.col("oid_unit").alias("_u1"))
    out = samples.withColumn("_base", base_oid(F.col("oid"))).join(by_base, "_base", "left")
    name, unit = F.col("_n1"), F.col("_u1")
    if not strict_parity:
        whole = table.select(F.col("known").alias("oid"), F.col("oid_name").alias("_n2"), F.col("oid_unit").alias("_u2"))
        out = out.join(whole, "oid", "left")
        name, unit = F.coalesce(name, "_n2"), F.coalesce(unit, "_u2")
    return (out.withColumns({"name": F.coalesce(name, F.col("oid")), "unit": F.coalesce(unit, F.lit(""))})
            .drop("_base", "_n1", "_u1", "_n2", "_u2"))


def sample_labels() -> Column:
    """The target's labels, its host, and the interface number if the identifier ends in one."""
    last = F.substring_index(F.col("oid"), ".", -1)
    index = F.when(F.contains(F.col("oid"), F.lit(".")) & last.rlike(r"^\d+$"), F.create_map(F.lit("ifIndex"), last))
    return merge_labels(merge_labels(F.col("labels"), F.create_map(F.lit("host"), F.col("host"))), index)


def source_name() -> Column:
    return F.format_string("snmp://%s:%d", F.col("host"), F.col("port"))


def device_key(strict_parity: bool = False) -> Column:
    """What a counter's previous reading is remembered under."""
    oid = base_oid(F.col("oid")) if strict_parity else F.col("oid")
    return F.concat_ws("/", F.concat_ws(":", F.col("host"), F.col("port").cast("string")), oid)


def parse_samples(samples: DataFrame, names: DataFrame | None = None, bits: int = 64,
                  strict_parity: bool = False, layout: Layout = DEFAULT) -> DataFrame:
    """Metric rows; octet counters become their increase since the previous poll, as ``<name>_delta``.

    The first poll of a counter keeps its raw value and name.  Interfaces are
    remembered apart; ``strict_parity`` lets those of one device overwrite each
    other in poll order (``seq``).
    """
    named = name_samples(samples, names, strict_parity)
    named = named.withColumns({"series_id": device_key(strict_parity), "value": F.col("value").cast("double")})
    counters = F.contains(F.col("name"), F.lit("Octets"))
    first = with_neighbour(named, ["seq", "value"], layout=layout)
    is_delta = counters & F.col("prev_seq").isNotNull()
    return first.select(
        F.when(is_delta, F.concat(F.col("name"), F.lit("_delta"))).otherwise(F.col("name")).alias("name"),
        null_if_nan(F.when(is_delta, wrap_delta(F.col("value"), F.col("prev_value"), bits))
                    .otherwise(F.col("value"))).alias("value"),
        "ts", sample_labels().alias("labels"), source_name().alias("source"), "unit", "seq")
