"""Cutting series into cells and blocks never changes a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from helpers import TINY, column
from pulsegrid.operators import ordering as od, stats as st
from pulsegrid.operators.ordering import Layout

RNG = np.random.default_rng(3)


@pytest.fixture
def uneven(series):
    at = np.sort(RNG.uniform(0, 20_000, 300)).round(3)
    at[50:60] = at[50]                      # ties, told apart by seq
    v = RNG.normal(10, 5, 300)
    v[RNG.random(300) < 0.3] = np.nan
    return series({"a": v, "b": -v}, seconds=at)


def plain(rows):
    return Window.partitionBy("series_id").orderBy("ts", "seq")


BURST = Layout(cell_seconds=1e9, max_cell_rows=20, block_rows=16)


@pytest.mark.parametrize("layout", [TINY, BURST], ids=["cells", "burst"])
def test_index_equals_plain_window(uneven, layout):
    got = od.with_index(uneven, layout).withColumn("want", F.row_number().over(plain(uneven)) - 1)
    assert got.filter("idx <> want").count() == 0
    assert got.count() == 600


def test_burst_on_one_timestamp_is_cut_by_seq(series):
    rows = series(np.arange(500.0), seconds=np.zeros(500))
    cut = od.with_cells(rows, Layout(max_cell_rows=50))
    largest = cut.groupBy(*od.CELL).count().agg(F.max("count")).first()[0]
    assert largest <= 50
    assert (column(od.with_index(cut), "idx") == np.arange(500)).all()


@pytest.mark.parametrize("layout", [TINY, BURST], ids=["cells", "burst"])
def test_neighbours_latest_and_running(uneven, layout):
    w = plain(uneven)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    want = uneven.withColumns({
        "p": F.lag("value").over(w), "n": F.lead("seq").over(w),
        "l": F.last("value", ignorenulls=True).over(back), "f": F.first("value", ignorenulls=True).over(ahead),
        "r": F.sum(F.coalesce("value", F.lit(0.0))).over(back)})
    got = od.with_neighbour(uneven, ["value"], "prev", layout=layout)
    got = od.with_neighbour(got, ["seq"], "next", forward=True, layout=layout)
    got = od.with_latest(got, F.col("value").isNotNull(), ["value"], "last", layout=layout)
    got = od.with_latest(got, F.col("value").isNotNull(), ["value"], "first", forward=True, layout=layout)
    got = od.with_around(got, F.col("value").isNotNull(), ["value"], "al", "ar", "c", layout)
    got = od.with_running(got, {"run": F.coalesce("value", F.lit(0.0))}, layout)
    for a, b in (("prev_value", "p"), ("next_seq", "n"), ("last.value", "l"), ("first.value", "f"),
                 ("al.value", "l"), ("ar.value", "f"), ("run", "r")):
        np.testing.assert_allclose(column(got, a), column(want, b), atol=1e-9)


def test_framed_equals_plain_window(uneven):
    w = plain(uneven)
    want = uneven.withColumn("m", F.avg("value").over(w.rowsBetween(-7, 5)))
    got = od.framed(uneven, 7, 5, lambda b: {"m": F.avg("value").over(b.rowsBetween(-7, 5))}, TINY)
    np.testing.assert_allclose(column(got, "m"), column(want, "m"))


def test_row_order_and_partitions_do_not_matter(uneven):
    a = column(od.with_index(uneven.repartition(7, "value"), TINY), "idx")
    b = column(od.with_index(uneven.orderBy(F.desc("value")).coalesce(1), TINY), "idx")
    assert (a == b).all()


@pytest.mark.parametrize("leaf_rows", [1, 10, 120, 10_000])
def test_quantiles_are_exact_for_any_leaf(series, leaf_rows):
    """Ranks found digit by digit, whatever the range, the sign and the ties of the values."""
    wide = np.concatenate([RNG.lognormal(0, 150, 900), -RNG.lognormal(0, 150, 900), [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 2.0 ** -1022]])
    shapes = {"big": np.concatenate([RNG.lognormal(0, 3, 2000), np.full(700, 1.5)]), "wide": wide, "same": np.full(500, -7.25),
              "close": 1e9 + np.arange(600) * 2.0 ** -20, "powers": 2.0 ** np.arange(-40, 40), "one": np.array([3.0])}
    rows = series({**shapes, "small": shapes["big"][:37], "none": np.array([np.nan])}, step=1.0)
    qs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.999, "e": 0.0, "f": 1.0}
    got = {r["series_id"]: r for r in st.quantiles(rows, qs, leaf_rows=leaf_rows).collect()}
    assert set(got) == {*shapes, "small"}
    for name, vals in {**shapes, "small": shapes["big"][:37]}.items():
        assert got[name]["n"] == len(vals)
        for k, q in qs.items():
            assert got[name][k] == pytest.approx(np.quantile(vals, q), rel=1e-12)


def test_sort_key_orders_all_doubles(spark):
    rng = np.random.default_rng(3)
    some = rng.integers(-2 ** 63, 2 ** 63, 20_000, dtype=np.int64).view(np.float64)
    edges = [s * x for s in (1.0, -1.0) for e in range(-1074, 1024, 7) for x in (2.0 ** e, np.nextafter(2.0 ** e, 0), np.nextafter(2.0 ** e, np.inf))]
    vals = np.concatenate([some[np.isfinite(some)], edges, [0.0, np.inf, -np.inf, 1.7976931348623157e308]])
    df = spark.createDataFrame(pd.DataFrame({"v": vals})).select("v", st.sort_key(F.col("v")).alias("k")).toPandas()
    df = df.sort_values("v", kind="stable")
    up, rise = np.diff(df.v.to_numpy()) > 0, np.diff(df.k.to_numpy())
    assert (rise[up] > 0).all() and (rise[~up] == 0).all()


def test_quantiles_of_infinite_values(series):
    rows = series({"s": [1.0, 2.0, float("inf"), float("inf"), 3.0]})
    got = st.quantiles(rows, {"a": 0.5, "b": 0.75, "c": 0.1}).first()
    assert (got["a"], got["b"]) == (3.0, float("inf")) and got["c"] == pytest.approx(1.4)


def test_burst_of_one_time_is_cut(spark, frame):
    """Half of the rows at one instant, some of them alike in every column: positions and carries stay right, cells stay small."""
    n = 600
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.to_datetime([0] * 100 + [60] * 400 + list(range(120, 220)), unit="s"),
                        "seq": list(range(100)) + [7] * 250 + list(range(100, 250)) + list(range(250, 350)),
                        "value": [1.0] * 100 + [2.0] * 400 + [3.0] * 100})
    rows = frame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    layout = Layout(cell_seconds=1e9, max_cell_rows=40, block_rows=16)
    cut = od.with_cells(rows, layout)
    assert cut.groupBy(*od.CELL).count().agg(F.max("count")).first()[0] <= 40
    got = od.with_running(od.with_index(cut, layout), {"total": F.col("value")}, layout).orderBy("idx").toPandas()
    assert got.idx.tolist() == list(range(n)) and got.total.tolist() == np.cumsum(sorted(pdf.value)).tolist()
    assert list(zip(got.ts, got.seq)) == sorted(zip(got.ts, got.seq))


def test_own_columns_named_like_ours_are_replaced(uneven):
    given = uneven.withColumns({"idx": F.lit(5), "cell": F.lit(1), "sub": F.lit(2)})
    assert (column(od.with_index(given, TINY), "idx") == column(od.with_index(uneven, TINY), "idx")).all()


def test_hot_series_is_spread_over_tasks(spark, frame):
    """A third of all rows in one series: no window task gets more than a cell or block."""
    pdf = pd.DataFrame({"series_id": ["hot"] * 3000 + [f"s{i % 60}" for i in range(6000)],
                        "ts": pd.to_datetime(np.arange(9000) % 3000 * 60, unit="s"), "seq": np.arange(9000),
                        "value": np.arange(9000.0)})
    rows = frame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    layout = Layout(cell_seconds=3600.0, block_rows=256)
    cells = od.with_cells(rows, layout).groupBy(*od.CELL).count().agg(F.max("count")).first()[0]
    blocks = od.with_blocks(od.with_index(rows, layout), 10, 10, layout).groupBy("series_id", "block").count()
    assert cells <= 60
    assert blocks.agg(F.max("count")).first()[0] <= 256 + 20
