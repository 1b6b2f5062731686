"""Ordered work inside a series without putting the series on one task.

``Window.partitionBy(series_id)`` sends a whole series to one task, which fails
once one series holds a large share of the data.  Here a series is cut in two
ways, and all ordered operators are built from them:

*cells*   contiguous stretches of time.  What an operator must know about the
          rows before a cell (row count, last row, last valid value, running
          sum) is one aggregate per cell, carried over the cells by a window on
          that small table and joined back to the rows.
*blocks*  exactly ``block_rows`` consecutive positions.  Bounded frames run per
          block; the rows at its edges are copied in as a halo and dropped
          afterwards.

Series order is always ``(ts, seq)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsegrid.schema import micros
from pulsegrid.session import sized, written

CELL = ["series_id", "cell", "sub"]
PIECES = 1024


@dataclass(frozen=True)
class Layout:
    """How finely series are cut.

    ``max_cell_rows`` bounds a cell: a burst that puts more rows than this into
    one stretch of time is cut again.
    """

    cell_seconds: float = 86_400.0
    max_cell_rows: int = 2_000_000
    block_rows: int = 65_536


DEFAULT = Layout()


def _ours(rows: DataFrame, name: str) -> bool:
    """Whether the column is one that this module added; a column of the user's with that name is replaced."""
    return name in rows.columns and rows.schema[name].metadata.get("pulsegrid") == name


def _mark(rows: DataFrame, *names: str) -> DataFrame:
    for name in names:
        rows = rows.withMetadata(name, {"pulsegrid": name})
    return rows


def _celled(rows: DataFrame, layout: Layout) -> DataFrame:
    """Add ``cell`` and ``sub`` by time alone; ``carry`` counts the rows of the cells and cuts those that are too long."""
    if _ours(rows, "cell"):
        return rows
    return _mark(rows.withColumns({
        "cell": F.floor(micros(F.col("ts")) / F.lit(layout.cell_seconds * 1e6)),
        "sub": F.lit(0).cast("bigint"),
    }), "cell", "sub")


def with_cells(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``cell`` and ``sub``; ``(cell, sub)`` rises with ``(ts, seq)``.

    The rows of every cell are counted, whatever the size of the input, and a cell with more than ``max_cell_rows``
    is cut by time, then by ``seq``, then by a hash of the row: rows of one time and ``seq`` are in any order anyway.
    """
    return _measured(_celled(rows, layout), {}, layout)[0]


def _measured(rows: DataFrame, aggs: dict[str, Column], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """``rows`` in cells of at most ``max_cell_rows``, and the written table of ``aggs`` by cell."""
    while True:
        small = written(rows.groupBy(*CELL).agg(F.count("*").alias("_rows"), *[c.alias(k) for k, c in aggs.items()]), "by-cell")
        if (small.agg(F.max("_rows")).first()[0] or 0) <= layout.max_cell_rows:
            return rows, small
        rows = _cut_again(rows, layout.max_cell_rows)


def _cut_again(rows: DataFrame, most: int) -> DataFrame:
    t, h = micros(F.col("ts")), F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind])
    hot = written(
        rows.groupBy(*CELL).agg(F.count("*").alias("_n"), F.min(t).alias("_t0"), F.max(t).alias("_t1"),
                                F.min("seq").alias("_s0"), F.max("seq").alias("_s1"), F.min(h).alias("_h0"), F.max(h).alias("_h1"))
        .filter(F.col("_n") > most), "hot-cells")
    by_time = (t - F.col("_t0")) / (F.col("_t1") - F.col("_t0") + 1)
    by_seq = (F.col("seq") - F.col("_s0")) / (F.col("_s1") - F.col("_s0") + 1)
    # rows that are alike in every column are dealt by chance, but the same way each time
    by_hash = F.when(F.col("_h1") > F.col("_h0"), F.pmod(h, F.lit(PIECES)) / PIECES).otherwise(
        F.pmod(F.monotonically_increasing_id(), F.lit(PIECES)) / PIECES)
    share = F.when(F.col("_t1") > F.col("_t0"), by_time).when(F.col("_s1") > F.col("_s0"), by_seq).otherwise(by_hash)
    piece = F.coalesce(F.floor(share * PIECES), F.lit(0))
    cut = rows.join(hot, CELL, "left").withColumn("sub", F.col("sub") * PIECES + piece)
    return _mark(written(cut.drop("_n", "_t0", "_t1", "_s0", "_s1", "_h0", "_h1"), "cells"), "cell", "sub")


def in_cell(ascending: bool = True) -> WindowSpec:
    """Series order inside one cell."""
    way = F.asc if ascending else F.desc
    return Window.partitionBy(*CELL).orderBy(way("ts"), way("seq"))


def _up_to_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(rows: DataFrame, aggs: dict[str, Column],
          carried: Callable[[WindowSpec, WindowSpec], dict[str, Column]], layout: Layout = DEFAULT) -> DataFrame:
    """Join onto each row what its cell inherits from the cells around it.

    ``aggs`` is evaluated per cell and written once, together with the number of rows, which tells whether a cell must be
    cut again first.  ``carried(before, after)`` turns those columns into inherited ones, with ``before`` walking forward
    in time up to the previous cell and ``after`` walking backward down to the next one.
    """
    rows, small = _measured(rows, aggs, layout)
    fwd = Window.partitionBy("series_id").orderBy("cell", "sub")
    back = Window.partitionBy("series_id").orderBy(F.desc("cell"), F.desc("sub"))
    cols = carried(fwd.rowsBetween(Window.unboundedPreceding, -1),
                   back.rowsBetween(Window.unboundedPreceding, -1))
    inherited = small.select(*CELL, *[c.alias(k) for k, c in cols.items()])
    return rows.join(inherited, CELL)


def with_index(rows: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``idx``, the 0-based position inside the series; a column of that name that is not this one's is replaced."""
    if _ours(rows, "idx"):
        return rows
    rows = _celled(rows, layout)
    rows = carry(rows, {"_n": F.count("*")},
                 lambda before, _: {"_start": F.coalesce(F.sum("_n").over(before), F.lit(0))}, layout)
    return _mark(rows.withColumn("idx", F.col("_start") + F.row_number().over(in_cell()) - 1)
                 .drop("_start"), "idx")


def with_neighbour(rows: DataFrame, cols: list[str], prefix: str = "prev", forward: bool = False,
                   index: bool = False, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``<prefix>_<col>`` from the previous row (the next one if ``forward``).

    ``index`` adds ``idx`` as well, at no further cost.
    """
    rows = _celled(rows, layout)
    edge = F.struct("ts", "seq", *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = carry(
        rows, {"_edge": F.min(edge) if forward else F.max(edge), "_n": F.count("*")},
        lambda before, after: {"_inherited": F.last("_edge").over(after if forward else before),
                               "_start": F.coalesce(F.sum("_n").over(before), F.lit(0))}, layout)
    near = F.coalesce(F.lag(edge).over(in_cell(ascending=not forward)), F.col("_inherited"))
    if index:
        rows = _mark(rows.withColumn("idx", F.col("_start") + F.row_number().over(in_cell()) - 1), "idx")
    return (rows.withColumn("_near", near)
            .withColumns({f"{prefix}_{c}": F.col(f"_near.v{i}") for i, c in enumerate(cols)})
            .drop("_near", "_inherited", "_start"))


def with_latest(rows: DataFrame, when: Column, cols: list[str], name: str, forward: bool = False,
                layout: Layout = DEFAULT) -> DataFrame:
    """Add struct ``name``: ``cols`` of the latest row, this one included, where ``when`` holds.

    With ``forward`` it is the first such row at or after this one.  NULL when
    there is none.
    """
    rows = _celled(rows, layout)
    found = F.when(when, F.struct("ts", "seq", *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)]))
    rows = rows.withColumn("_found", found)
    rows = carry(
        rows, {"_edge": F.min("_found") if forward else F.max("_found")},
        lambda before, after: {
            "_inherited": F.last("_edge", ignorenulls=True).over(after if forward else before)}, layout)
    here = F.last("_found", ignorenulls=True).over(_up_to_here(in_cell(ascending=not forward)))
    rows = rows.withColumn("_found", F.coalesce(here, F.col("_inherited")))
    picked = F.struct(*[F.col(f"_found.v{i}").alias(c) for i, c in enumerate(cols)])
    return (rows.withColumn(name, F.when(F.col("_found").isNotNull(), picked))
            .drop("_found", "_inherited"))


def with_around(rows: DataFrame, when: Column, cols: list[str], left: str, right: str, count: str,
                layout: Layout = DEFAULT) -> DataFrame:
    """:func:`with_latest` in both directions at once, and how often ``when`` holds in the series."""
    rows = _celled(rows, layout)
    found = F.when(when, F.struct("ts", "seq", *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)]))
    rows = rows.withColumn("_found", found)
    whole = Window.partitionBy("series_id")
    rows = carry(
        rows, {"_first": F.min("_found"), "_last": F.max("_found"), "_c": F.count("_found")},
        lambda before, after: {"_in_l": F.last("_last", ignorenulls=True).over(before),
                               "_in_r": F.last("_first", ignorenulls=True).over(after),
                               count: F.sum("_c").over(whole)}, layout)
    for name, asc, inherited in ((left, True, "_in_l"), (right, False, "_in_r")):
        here = F.last("_found", ignorenulls=True).over(_up_to_here(in_cell(asc)))
        rows = rows.withColumn(inherited, F.coalesce(here, F.col(inherited)))
        picked = F.struct(*[F.col(f"{inherited}.v{i}").alias(c) for i, c in enumerate(cols)])
        rows = rows.withColumn(name, F.when(F.col(inherited).isNotNull(), picked))
    return rows.drop("_found", "_in_l", "_in_r")


def with_running(rows: DataFrame, sums: dict[str, Column], layout: Layout = DEFAULT) -> DataFrame:
    """Add running totals, this row included."""
    rows = _celled(rows, layout)
    rows = carry(
        rows, {f"_{k}": F.sum(c) for k, c in sums.items()},
        lambda before, _: {f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(before), F.lit(0))
                           for k in sums}, layout)
    w = _up_to_here(in_cell())
    return (rows.withColumns({k: F.col(f"_in_{k}") + F.coalesce(F.sum(c).over(w), F.lit(0))
                              for k, c in sums.items()})
            .drop(*[f"_in_{k}" for k in sums]))


def with_running_max(rows: DataFrame, name: str, layout: Layout = DEFAULT) -> DataFrame:
    """Replace column ``name`` by its largest value so far, this row included."""
    rows = _celled(rows, layout)
    rows = carry(rows, {"_top": F.max(name)}, lambda before, _: {"_in": F.max("_top").over(before)}, layout)
    return rows.withColumn(name, F.greatest("_in", F.max(name).over(_up_to_here(in_cell())))).drop("_in")


def block_size(before: int, after: int, layout: Layout = DEFAULT) -> int:
    return max(layout.block_rows, 4 * (before + after))


def with_blocks(rows: DataFrame, before: int, after: int, layout: Layout = DEFAULT) -> DataFrame:
    """Add ``block`` and ``own``; edge rows are repeated as halo with ``own`` false."""
    size = block_size(before, after, layout)
    idx = F.col("idx")
    first = F.greatest(F.lit(0), F.floor((idx - after) / size)).cast("bigint")
    last = F.floor((idx + before) / size).cast("bigint")
    return (rows.withColumn("block", F.explode(F.sequence(first, last)))
            .withColumn("own", F.floor(idx / size) == F.col("block")))


def framed(rows: DataFrame, before: int, after: int,
           cols: Callable[[WindowSpec], dict[str, Column]], layout: Layout = DEFAULT) -> DataFrame:
    """Evaluate window columns whose frames reach ``before`` rows back and ``after`` ahead.

    ``cols`` receives the block's window, ordered by ``idx``.
    """
    rows = with_blocks(with_index(rows, layout), before, after, layout)
    w = Window.partitionBy("series_id", "block").orderBy("idx")
    return rows.withColumns(cols(w)).filter("own").drop("block", "own")


def smallest_per_series(rows: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each series under ``order``.

    Written as ``row_number() <= k`` because Spark keeps only ``k`` rows per
    series in each map task before the shuffle.
    """
    w = Window.partitionBy("series_id").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def last_per_series(rows: DataFrame, k: int, layout: Layout = DEFAULT) -> DataFrame:
    """The last ``k`` rows of each series.

    Row counts per cell tell which cells can hold them; only the rows of those
    cells, about ``k`` and one cell per series, are shuffled.
    """
    celled = _celled(rows, layout)
    counts = celled.groupBy(*CELL).agg(F.count("*").alias("_n"))
    later = Window.partitionBy("series_id").orderBy(F.desc("cell"), F.desc("sub")).rowsBetween(
        Window.unboundedPreceding, -1)
    needed = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_later") < k)
    near = celled.join(sized(needed.select(*CELL), "cells"), CELL, "left_semi")
    return smallest_per_series(near, k, F.desc("ts"), F.desc("seq")).select(*rows.columns)
