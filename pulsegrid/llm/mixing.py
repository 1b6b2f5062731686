"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document of a source stands in a queue in a shuffled order that its key fixes, once for each time the source may be
used.  Its virtual finish time is the source's words up to its end divided by the source's target.  All entries are then
range-sorted by virtual finish time, their words summed in that order, and the mix is what comes before the total budget,
the sum of the targets, is spent; the entry at the cut is served in part.  So sources reach their targets together, to
within a document each.

Running sums are taken in range partitions and over one row for each, so a source with a third of all rows is spread
over many tasks.  Sources themselves, one row each, pass one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import written

WORD = r"[^\x20\x09-\x0D]+"

#: Columns that ``schedule`` adds.
ADDED = ("size", "source_size", "target", "place", "entries")


def words(text: str) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each (nosource, source, source_size) row: its weight's part of ``share`` times all sizes, ``most`` times its size at most.

    What exceeds a limit goes to the others by weight, until none is above: with sources in order of
    limit / weight, those before the first that its part does not fill are the ones at their limit.
    """
    everything = Window.partitionBy()
    ranked = Window.orderBy("__nosource", "__source")
    filled = Window.orderBy("__ratio", "__nosource", "__source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    part = (F.col("__budget") - F.col("__before")) / F.col("__rest")
    return (sizes
            .withColumn("__weight", weight)
            .withColumn("__limit", F.col("source_size") * F.lit(float(most)))
            .withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("__ratio", F.col("__limit") / F.col("__weight"))
            .withColumn("__before", F.coalesce(F.sum("__limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("__rest", F.sum("__weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("__level", F.max(F.when(part <= F.col("__ratio"), part)).over(everything))
            .withColumn("target", F.least(F.col("__limit"), F.col("__weight") * F.coalesce("__level", F.lit(1e300))))
            .select("__nosource", "__source", "source_size", "target"))


def _running(rows: DataFrame, order: list[str], by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in ``order`` and within equal ``by``, which ``order`` begins with.

    The rows are sorted by ranges, so that many equal keys spread by the later columns; sums of whole partitions, one row
    for each and value of ``by``, give what the earlier ones hold.
    """
    way = [F.asc(c) for c in order]
    placed = written(rows.repartitionByRange(*way).sortWithinPartitions(*way).withColumn("__at", F.monotonically_increasing_id()), "queue")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    line = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by, "__part").agg(F.sum(value).alias("__sum")).select(
        *by, "__part", F.coalesce(F.sum("__sum").over(line), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.join(before, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__at", "__part", "__before", "__inside")


def schedule(df: DataFrame, id: str = "doc_id", source: str = "source", size: Column | None = None,
             weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """All rows of ``df`` with size, source_size, target, place and entries; columns of these names are replaced.

    ``place`` numbers the rows.  ``entries`` holds for each use of the row its number (from 0), virtual finish time and the
    words served: all before the total budget is spent, what is left of it at the cut, none after.  Sources weigh ``weights``
    in turn, by code point, null last.  A row without words has no entries, a null text size 0; a null or repeated
    key is a key like any other, and equal rows are interchangeable.
    """
    size = words("text") if size is None else size
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))))
    keep = [c for c in df.columns if c not in ADDED]
    rows = written(df.select(
        *[F.col(f"`{c}`") for c in keep], size.alias("size"), F.monotonically_increasing_id().alias("place"),
        shuffled.alias("__order"), F.col(f"`{source}`").isNull().alias("__nosource"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("__source")), "mix")
    key = ["__nosource", "__source"]
    slim = rows.select(*key, "__order", "size", "place", F.col(f"`{id}`").alias("__id"))
    goals = written(targets(slim.groupBy(*key).agg(F.sum("size").alias("source_size")), weights, share, most), "goals")
    budget = math.floor((goals.agg(F.sum("target")).first()[0] or 0.0) + 1e-6)
    queue = _running(slim, [*key, "__order", "__id", "size", "place"], key, "size", "__start").join(goals, key).where("size > 0 and target > 0")

    start = F.col("__start") + F.col("source_size") * F.col("use")
    room = F.least(F.col("size"), F.floor(F.col("source_size") * F.lit(float(most))) - start)  # what the limit of the source leaves
    uses = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))
    entry = queue.withColumn("use", uses).select(
        ((start + F.col("size")) / F.col("target")).alias("finish"), "__order", "__id", "use", *key, "place", room.alias("room")).where("room > 0")
    stream = _running(entry, ["finish", "__order", "__id", "use", *key, "place"], [], "room", "__ahead")
    served = F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.lit(budget) - F.col("__ahead")))
    entries = stream.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("use", "finish", served.alias("served")))).alias("entries"))
    return rows.join(goals, key).join(entries, "place", "left").select(*[F.col(f"`{c}`") for c in keep], *ADDED)


def mix(scheduled: DataFrame) -> DataFrame:
    """The mix: the rows served, once for each use, in order of virtual finish time, with ``served`` words each."""
    added = [c for c in scheduled.columns if c != "entries"]
    stream = scheduled.select(*[F.col(f"`{c}`") for c in added], F.explode("entries").alias("__e")).where("__e.served > 0")
    return (stream.select(*[F.col(f"`{c}`") for c in added], F.col("__e.use").alias("use"),
                          F.col("__e.finish").alias("finish"), F.col("__e.served").alias("served"))
            .orderBy("finish", "place", "use"))


def first_words(text: str, count: str) -> Column:
    """The text to the end of its first ``count`` words, white space kept."""
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.col(count).cast("int")), "")
