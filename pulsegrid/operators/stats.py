"""Per-series statistics.

All are plain aggregates (partial + final), joined back to the rows, so a hot
series is pre-aggregated in every task instead of being gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.ordering import DEFAULT, Layout, with_neighbour
from pulsegrid.schema import micros
from pulsegrid.session import shared, sized, written

#: Bits that a round of the selection looks at, and values of one rank that may be sorted in a task.
DIGIT = 16
LEAF_ROWS = 1 << 16


def join_stats(rows: DataFrame, stats: DataFrame, on: str | list[str] = "series_id",
               how: str = "left") -> DataFrame:
    """Join per-series values onto rows; broadcast only if the planner knows they fit."""
    return rows.join(sized(stats), on, how)


def moments(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """n, mean, population sd, min and max of the non-missing values."""
    v = F.col(value)
    return rows.groupBy(*(by or ["series_id"])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        F.min(v).alias("vmin"), F.max(v).alias("vmax"))


def sort_key(v: Column) -> Column:
    """A bigint that orders as the doubles ``v`` do, different values apart: the bits of |v|, negated below zero; NaN comes last."""
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")  # may be one off next to a power of two
    exponent = guess + F.when(size < F.pow(F.lit(2.0), guess), -1).when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
    normal = (exponent + 1023).cast("bigint") * (1 << 52) + ((size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("bigint")
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("bigint")  # below 2**-1022 the value counts steps of 2**-1074
    top = F.lit(2047 << 52)
    bits = (F.when(F.isnan(v), top + 1).when(size == float("inf"), top).when(size < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(v < 0, -bits).otherwise(bits)


def quantiles(rows: DataFrame, qs: dict[str, float], value: str = "value", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles per series: ``n`` and one column per name.

    Radix selection: 16 bits of the values' order-preserving keys at a time, a histogram of each series tells in which
    digit the wanted ranks lie, and only values with the digits found so far go on, until those of a rank are counted as at
    most ``leaf_rows``, or equal.  So a task holds one histogram or one leaf of a series, however long that is.
    """
    v = F.col(value).cast("double")
    wanted = [float(q) for q in qs.values()]
    rows = rows.select("series_id", v.alias("v")).filter("v is not null")
    longest = rows.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    if longest <= leaf_rows:  # no digit is needed: every series is a leaf
        leaf = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.percentile("v", F.array(*[F.lit(q) for q in wanted])).alias("_q"))
        return leaf.select("series_id", "n", *[F.col("_q")[k].alias(name) for k, name in enumerate(qs)])
    keys = shared(rows.withColumn("key", sort_key(F.col("v"))), "keys")
    shift = 64
    state = None
    while state is None or (shift > 0 and not state.filter(F.array_max("rank.inside") > leaf_rows).isEmpty()):
        shift -= DIGIT
        state = written(_narrowed(keys, state, wanted, shift), "ranks")
    found = _candidates(keys, state, shift).groupBy("series_id", F.shiftright("key", shift).alias("digits")).agg(
        F.first("n").alias("n"), F.first("rank").alias("rank"),
        (F.array(F.min("v")) if shift == 0 else F.sort_array(F.collect_list("v"))).alias("leaf"))
    at = lambda k: F.col("rank")[k]
    place = lambda k: F.lit(0) if shift == 0 else (at(k)["rank"] - at(k)["below"]).cast("int")
    ends = found.groupBy("series_id").agg(F.first("n").alias("n"), *[
        F.max(F.when(at(k)["digits"] == F.col("digits"), F.get("leaf", place(k)))).alias(f"r{k}") for k in range(2 * len(wanted))])

    def between(k: int, q: float) -> Column:
        low, high, pos = F.col(f"r{2 * k}"), F.col(f"r{2 * k + 1}"), (F.col("n") - 1) * F.lit(q)
        return F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return ends.select("series_id", "n", *[between(k, q).alias(name) for k, (name, q) in enumerate(zip(qs, wanted))])


def _places(wanted: list[float]) -> list[Column]:
    """The ranks from 0, in a series of ``n`` values, on both sides of each quantile."""
    return [side((F.col("n") - 1) * F.lit(q)).cast("bigint") for q in wanted for side in (F.floor, F.ceil)]


def _candidates(keys: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Values that share the digits down to ``shift`` with a wanted rank of their series, and its ranks."""
    return keys.join(state, "series_id").filter(F.array_contains(F.col("rank.digits"), F.shiftright("key", shift)))


def _narrowed(keys: DataFrame, state: DataFrame | None, wanted: list[float], shift: int) -> DataFrame:
    """(series_id, n, rank): for each wanted rank its digits down to ``shift``, the values below them and those inside."""
    digits = F.shiftright("key", shift).alias("digits")
    if state is None:
        counted = keys.groupBy("series_id", digits).agg(F.count("*").alias("w"))
    else:
        counted = _candidates(keys, state, shift + DIGIT).groupBy("series_id", digits).agg(
            F.count("*").alias("w"), F.first("n").alias("n"), F.first("rank").alias("rank"))
    stem = F.shiftright("digits", DIGIT)
    upto = Window.partitionBy("series_id", stem).orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("end", F.sum("w").over(upto))
    if state is None:
        counted = counted.withColumn("before", F.sum("w").over(Window.partitionBy("series_id").orderBy("digits")) - F.col("w")).withColumn(
            "n", F.sum("w").over(Window.partitionBy("series_id")))
        counted = counted.withColumn("places", F.array(*_places(wanted)))
        rank, below = (lambda k: F.col("places")[k]), (lambda k: F.col("before"))
        mine = lambda k: F.lit(True)
    else:
        rank = lambda k: F.col("rank")[k]["rank"]
        below = lambda k: F.col("rank")[k]["below"] + F.col("end") - F.col("w")
        mine = lambda k: F.col("rank")[k]["digits"] == stem
    hits = [F.max(F.when(mine(k) & (rank(k) >= below(k)) & (rank(k) < below(k) + F.col("w")), F.struct(
        rank(k).alias("rank"), F.col("digits"), below(k).alias("below"), F.col("w").alias("inside")))) for k in range(2 * len(wanted))]
    return counted.groupBy("series_id").agg(F.first("n").alias("n"), F.array(*hits).alias("rank"))


def mad(rows: DataFrame, value: str = "value") -> DataFrame:
    """n, median and the median absolute deviation from it."""
    mid = quantiles(rows, {"median": 0.5}, value)
    dev = join_stats(rows, mid, how="inner").withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return mid.join(quantiles(dev, {"mad": 0.5}, "_d").drop("n"), "series_id")


def steps(rows: DataFrame, index: bool = False, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``dt``, the seconds since the previous row of the series (and ``idx``)."""
    rows = with_neighbour(rows, ["ts"], index=index, layout=layout)
    return (rows.withColumn("dt", (micros(F.col("ts")) - micros(F.col("prev_ts"))) / F.lit(1e6))
            .drop("prev_ts"))


def median_interval(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Median spacing of a series in seconds, as ``interval``."""
    return quantiles(steps(rows, layout=layout), {"interval": 0.5}, "dt").drop("n")


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def guarded(c: Column, instead: float = 1.0) -> Column:
    """A spread of zero (or unknown) would divide by zero; use ``instead``."""
    return F.when(c.isNull() | (c == 0), F.lit(instead)).otherwise(c)
