"""What surrounds an anomaly: time of the week, and other metrics in trouble."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalar import temporal_context, threshold_multiplier
from pulsegrid.operators.ordering import DEFAULT, Layout, with_neighbour, with_running
from pulsegrid.schema import micros
from pulsegrid.session import written


def with_temporal_context(rows: DataFrame, business_hours: tuple[int, int] = (8, 18),
                          zone: str = "UTC") -> DataFrame:
    return rows.withColumns(temporal_context(F.col("ts"), business_hours, zone))


def suppress_by_context(anomalies: DataFrame, business_hours: tuple[int, int] = (8, 18),
                        schedule: dict[str, float] | None = None, zone: str = "UTC") -> DataFrame:
    """Drop anomalies too weak for the time of the week they happened at."""
    need = threshold_multiplier(F.col("ts"), business_hours, schedule, zone) * 0.5
    return anomalies.filter(F.col("score") >= need)


def coincidences(anomalies: DataFrame, time_window: float = 300.0, layout: Layout = DEFAULT) -> DataFrame:
    """``(metric, island)``: which metrics take part in which run of close anomalies.

    An island is a maximal run of anomalies, of any metric, with no step above
    ``time_window`` seconds.  Two metrics with anomalies that close share an
    island, and metrics that share one are linked through such pairs, so islands
    carry the whole correlation graph without listing a pair.
    """
    # one timeline over all metrics: cut in cells of time like any long series
    line = anomalies.select("ts", F.col("series_id").alias("metric")).distinct()
    line = line.withColumns({"series_id": F.lit("all"), "seq": F.xxhash64("metric")})
    line = with_neighbour(line, ["ts"], layout=layout)
    starts = F.coalesce(micros(F.col("ts")) - micros(F.col("prev_ts")) > time_window * 1e6, F.lit(True))
    line = with_running(line, {"island": starts.cast("bigint")}, layout)
    return line.select("metric", "island").distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, component)``: components of a bipartite graph, named by their smallest ``a``.

    Each round every node takes the smallest label around it, then the label of
    that label, so chains shorten by more than one step per round.
    """
    edges = written(edges.select(a, b), "edges")
    labels = written(edges.select(a).distinct().withColumn("component", F.col(a)), "labels")
    while True:
        around = (edges.join(labels, a).groupBy(b).agg(F.min("component").alias("component"))
                  .join(edges, b).groupBy(a).agg(F.min("component").alias("near")))
        hop = around.select(F.col(a).alias("near"), F.col("near").alias("far"))
        stepped = around.join(hop, "near", "left").select(
            a, F.least("near", F.coalesce("far", "near")).alias("component"))
        stepped = written(stepped, "labels")
        old = labels.select(a, F.col("component").alias("old"))
        settled = stepped.join(old, a).filter(F.col("component") != F.col("old")).isEmpty()
        labels = stepped
        if settled:
            return labels


def correlated_metrics(anomalies: DataFrame, time_window: float = 300.0,
                       layout: Layout = DEFAULT) -> DataFrame:
    """``(metric, component, size)`` for metrics whose anomalies chain together in time.

    Only components of two or more metrics; a lone metric is reported when it is
    the only one there is.
    """
    parts = connected(coincidences(anomalies, time_window, layout), "metric", "island")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    if parts.limit(2).count() > 1:
        sizes = sizes.filter("size > 1")
    return parts.join(sizes, "component").select("metric", "component", "size")
