import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import TINY, column
from pulsegrid.functions import scalar as sc
from pulsegrid.operators import counters as ct, gaps as gp, normalize as nm, outliers as ot, resample as rs, seasonal as se
from pulsegrid.operators.ordering import Layout
from pulsegrid.plans.preprocess import PreprocessConfig, preprocess, steps_applied

N = np.nan


def test_counter_wrap_and_first_row(series):
    got = ct.unwrap_counters(series([2**32 - 100, 50, 150, 150]), bits=32)
    assert column(got).tolist() == [0, 150, 100, 0]


def test_counter_reset_above_max_rate(series):
    got = ct.unwrap_counters(series([100, 200, 50, 150]), bits=32, max_rate=200)
    assert column(got).tolist() == [0, 100, 0, 100]


def test_counter_missing_neighbour_and_short_series(series):
    got = ct.unwrap_counters(series({"a": [1, None, 3, 7], "b": [9]}))
    np.testing.assert_equal(column(got), [0, N, N, 4, 0])


def test_counter_wraps(series):
    assert column(ct.counter_wraps(series([1, 5, 2, 2, 1]), TINY), "wrapped").tolist() == [0, 0, 1, 0, 1]


@pytest.mark.parametrize("name,expected", [
    ("http_requests_total", True), ("request_COUNT", True), ("latency_sum", True), ("ifInOctets", True),
    ("memory_bytes", True), ("cpu_usage_percent", False), ("totals", False), ("temperature", False)])
def test_counter_names(spark, name, expected):
    assert spark.range(1).select(sc.is_counter_name(F.lit(name))).first()[0] is expected


def test_gap_positions(series):
    got = gp.detect_gaps(series([0] * 5, seconds=[0, 60, 120, 500, 560])).collect()
    assert [(r.start_idx, r.end_idx, r.duration) for r in got] == [(2, 3, 380.0)]
    assert gp.detect_gaps(series([0]))  .count() == 0


def test_linear_fill_and_edges(series):
    got = gp.fill_gaps(series([None, 10, None, None, 40, None]))
    assert column(got).tolist() == [10, 10, 20, 30, 40, 40]


def test_linear_fill_needs_two_values(series):
    np.testing.assert_equal(column(gp.fill_gaps(series([None, 5, None]))), [N, 5, N])


def test_linear_fill_with_limit(series):
    # interior gap of 180 s, trailing distances 60 and 120 s; a leading gap never fills
    got = gp.fill_gaps(series([None, 1, None, None, 4, None, None]), max_gap=100)
    np.testing.assert_equal(column(got), [N, 1, N, N, 4, 4, N])
    got = gp.fill_gaps(series([None, 1, None, None, 4, None, None]), max_gap=180)
    np.testing.assert_allclose(column(got), [N, 1, 2, 3, 4, 4, 4])


def loop_fill(at, v, limit, backward):
    """Row by row: copy the neighbour unless the step to it is too wide."""
    v = list(v)
    order = range(len(v) - 2, -1, -1) if backward else range(1, len(v))
    for i in order:
        j = i + 1 if backward else i - 1
        if np.isnan(v[i]) and not np.isnan(v[j]) and (limit is None or abs(at[i] - at[j]) <= limit):
            v[i] = v[j]
    return v


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("limit", [None, 90.0])
def test_directional_fill_equals_loop(series, backward, limit):
    rng = np.random.default_rng(5)
    at = np.cumsum(rng.choice([30.0, 60.0, 120.0], 200, p=[0.5, 0.4, 0.1]))
    v = np.where(rng.random(200) < 0.6, np.nan, rng.normal(size=200))
    got = gp.fill_gaps(series(v, seconds=at), "bfill" if backward else "ffill", limit, TINY)
    np.testing.assert_allclose(column(got), loop_fill(at, v, limit, backward))


def test_unknown_fill_is_linear_and_zero_fill(series):
    rows = series([1, None, 3])
    assert column(gp.fill_gaps(rows, "spline")).tolist() == [1, 2, 3]
    assert column(gp.fill_gaps(rows, "zero")).tolist() == [1, 0, 3]


OUT = [50, 51, 49, 52, 48, 150, 50, 51]


def test_outlier_masks(series):
    assert column(ot.outliers_iqr(series(OUT)), "is_outlier").tolist() == [0] * 5 + [1, 0, 0]
    assert column(ot.outliers_modified_zscore(series(OUT)), "is_outlier").tolist() == [0] * 5 + [1, 0, 0]
    assert column(ot.outliers_zscore(series(OUT), 2.0), "is_outlier").tolist() == [0] * 5 + [1, 0, 0]


def test_outliers_need_values_and_spread(series):
    rows = series({"few": [1, 2, 900], "flat": [5, 5, 5, 5], "none": [None, None]})
    for method in ot.METHODS[:2]:
        assert column(ot.mark_outliers(rows, method), "is_outlier").sum() == 0
    assert column(ot.outliers_modified_zscore(series([5, 5, 5, 90])), "is_outlier").sum() == 0  # no deviation


@pytest.mark.parametrize("replacement,expected", [("nan", N), ("median", 50.0), ("mean", 351 / 7), ("clip", 52.0)])
def test_replacements(series, replacement, expected):
    got = column(ot.replace_outliers(series(OUT), "iqr", replacement))
    np.testing.assert_allclose(got, [50, 51, 49, 52, 48, expected, 50, 51])


def test_replacement_names_are_checked(series):
    with pytest.raises(ValueError):
        ot.replace_outliers(series(OUT), "nope")
    with pytest.raises(ValueError):
        ot.replace_outliers(series(OUT), "iqr", "nope")


def test_clip(series):
    v = np.arange(101.0)
    got = column(ot.clip_outliers(series(v), 10, 90))
    assert got.min() == 10 and got.max() == 90
    assert column(ot.clip_outliers(series([7]))).tolist() == [7]


def test_resample(series):
    rows = series([1, 2, 3, 4, 5, 6, 7], seconds=[0, 55, 130, 180, 241, 300, 362])
    got = rs.resample_uniform(rows, 60.0)
    # ceil(362/60) = 7 bins
    np.testing.assert_equal(column(got), [1.5, N, 3, 4, 5, 6, 7])
    assert [r.ts.timestamp() for r in got.orderBy("seq").collect()][:2] == [30, 90]
    for method, want in (("sum", 3), ("max", 2), ("min", 1), ("first", 1), ("last", 2)):
        assert column(rs.resample_uniform(rows, 60.0, method))[0] == want
    with pytest.raises(ValueError):
        rs.resample_uniform(rows, 60.0, "mode")


def test_resample_clamps_into_edge_bins_and_skips_missing(series):
    rows = series([1, None, 3, 9], seconds=[0, 60, 120, 600])
    end = F.timestamp_seconds(F.lit(180))
    np.testing.assert_equal(column(rs.resample_uniform(rows, 60.0, "last", end=end)), [1, N, 9])


def test_resample_single_row_and_same_time(series):
    assert column(rs.resample_uniform(series([4]))).tolist() == [4]
    assert column(rs.resample_uniform(series([4, 8], seconds=[5, 5]))).tolist() == [6]


def test_grid_in_chunks(series, monkeypatch):
    rows = series([1, 2], seconds=[0, 10_000])
    want = column(rs.resample_uniform(rows, 60.0))
    monkeypatch.setattr(rs, "GRID_CHUNK", 7)
    np.testing.assert_equal(column(rs.resample_uniform(rows, 60.0)), want)


def test_downsample(series):
    rows = series(np.arange(95.0))
    got = column(rs.downsample(rows, 10, layout=TINY))
    assert got[0] == 4.5 and len(got) == 10 and got[-1] == 92
    assert column(rs.downsample(rows, 10, "max"))[0] == 9
    assert len(column(rs.downsample(rows, 1))) == 95
    assert column(rs.downsample(rows, 10, "other"))[0] == 4.5


def test_normalisers(series):
    v = np.array([10, 20, 30, 40, 50.0])
    np.testing.assert_allclose(column(nm.z_normalize(series(v))), (v - 30) / v.std())
    np.testing.assert_allclose(column(nm.minmax_normalize(series(v), feature_range=(-1, 1))), [-1, -.5, 0, .5, 1])
    np.testing.assert_allclose(column(nm.robust_normalize(series(v))), (v - 30) / 20)
    np.testing.assert_allclose(column(nm.log_normalize(series([-5, 0, 9, None]))), [0, 0, np.log(10), N])


def test_normalising_constant_series(series):
    flat = series([3, 3, 3, 3])
    assert column(nm.z_normalize(flat)).tolist() == [0] * 4
    assert column(nm.minmax_normalize(flat, feature_range=(2, 5))).tolist() == [2] * 4
    assert column(nm.robust_normalize(flat)).tolist() == [0] * 4


def test_saved_parameters(series):
    fitted = nm.fit_zscore(series([0, 10]))
    assert column(nm.z_normalize(series([15]), fitted)).tolist() == [2]


def average(v, half):
    out = []
    for i in range(len(v)):
        w = v[max(0, i - half):i + half + 1]
        w = w[~np.isnan(w)]
        out.append(w.mean() if len(w) else np.nan)
    return np.array(out)


def decomposed(v, period, mult=False):
    trend = average(v, period // 2)
    off = v / np.where(trend == 0, np.nan, trend) if mult else v - trend
    phase = np.arange(len(v)) % period
    raw = np.array([np.nanmean(off[phase == p]) if np.isfinite(off[phase == p]).any() else 0 for p in range(period)])
    raw = raw / raw.mean() if mult and raw.mean() else raw if mult else raw - raw.mean()
    seasonal = raw[phase]
    prod = trend * seasonal
    return trend, seasonal, v / np.where(prod == 0, np.nan, prod) if mult else v - trend - seasonal


@pytest.mark.parametrize("mult", [False, True])
@pytest.mark.parametrize("as_table", [False, True])
def test_decomposition(spark, series, seasonal_values, mult, as_table):
    v = seasonal_values + (30 if mult else 0)
    v[[10, 11, 90]] = np.nan
    period = spark.createDataFrame([("s", 24)], "series_id string, period int") if as_table else 24
    got = se.seasonal_decompose(series(v), period, "multiplicative" if mult else "additive", TINY)
    for name, want in zip(("trend", "seasonal", "residual"), decomposed(v, 24, mult)):
        np.testing.assert_allclose(column(got, name), want, atol=1e-9)


def test_period_per_series(series, seasonal_values):
    i = np.arange(1500)
    slow = np.sin(2 * np.pi * i / 50) + np.random.default_rng(1).normal(0, .1, 1500)
    rows = series({"day": np.resize(seasonal_values - np.arange(200) / 20, 1500), "fifty": slow, "flat": np.ones(1500)})
    got = {r.series_id: r.period for r in se.estimate_period(rows).collect()}
    assert abs(got["fifty"] % 50) <= 2 or abs(got["fifty"] % 50) >= 48
    assert got["flat"] == 2


def brute_period(v, lo=2, hi=None):
    n = len(v)
    hi = min(max(lo + 1, n // 3) if hi is None else hi, n // 2)
    c = np.where(np.isnan(v), np.nanmean(v), v)
    c = c - c.mean()
    dots = [np.dot(c[:n - k], c[k:]) for k in range(lo, hi + 1)]
    return lo + int(np.argmax(dots))


@pytest.mark.parametrize("n", [5, 40, 700, 1300])
def test_period_equals_brute_force(series, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n) + 2 * np.sin(np.arange(n) / 9)
    v[rng.random(n) < 0.05] = np.nan
    assert se.estimate_period(series(v)).first().period == brute_period(v)


@pytest.mark.parametrize("n,band", [(700, 64), (1300, 256), (3000, 32), (3000, 1 << 20)])
def test_period_in_bands(series, n, band):
    """A series cut into bands of a transform, one that fits, and one that is flat, side by side."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=n) + 2 * np.sin(np.arange(n) / 9)
    v[rng.random(n) < 0.05] = np.nan
    w = rng.normal(size=37)
    got = {r.series_id: r.period for r in se.estimate_period(
        series({"long": v, "short": w, "flat": np.ones(n), "inf": np.r_[np.inf, np.zeros(n)]}), band=band).collect()}
    assert got == {"long": brute_period(v), "short": brute_period(w), "flat": 2, "inf": 2}


def test_period_ties_take_the_shortest_lag(series):
    v = np.zeros(400)
    v[[0, 50, 120]] = 1  # three lags of one product, but for the mean
    want = brute_period(v)
    assert se.estimate_period(series(v)).first().period == want
    assert se.estimate_period(series(v), band=64).first().period == want


def test_period_limits(series):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    for lo, hi in ((2, 2), (7, 30), (100, 240), (2, 10_000)):
        got = se.estimate_period(series(v), lo, hi, band=64).first().period
        assert got == brute_period(v, lo, hi)


def test_short_series_period(series):
    assert se.estimate_period(series([1, 2, 3])).first().period == 2


def test_preprocess_steps_in_order(series):
    rows = series({"net_bytes": [10, 30, 20, None, 60], "cpu": [1, None, 3, 2, 2]})
    cfg = PreprocessConfig(counter_bits=32, handle_outliers=False)
    got = preprocess(rows, cfg)
    cpu = column(got.filter("series_id = 'cpu'"))
    assert cpu.tolist() == [1, 2, 3, 2, 2]
    steps = {r.series_id: r.steps for r in steps_applied(rows, cfg).collect()}
    assert steps == {"net_bytes": ["unwrap_counters", "fill_gaps"], "cpu": ["fill_gaps"]}


def test_preprocess_normalisers(series):
    rows = series([10, 20, 30, 40, 50])
    base = dict(handle_outliers=False, normalize=True)
    assert column(preprocess(rows, PreprocessConfig(**base, normalize_method="minmax"))).tolist() == [0, .25, .5, .75, 1]
    same = PreprocessConfig(**base, normalize_method="minmax", strict_parity=True)
    assert column(preprocess(rows, same)).tolist() == [10, 20, 30, 40, 50]
    with pytest.raises(ValueError):
        preprocess(rows, PreprocessConfig(**base, normalize_method="other"))


def test_preprocess_resamples_then_replaces(series, spiky):
    got = preprocess(series(spiky, step=30.0), PreprocessConfig(resample=True, resample_interval=60.0))
    v = column(got)
    assert len(v) == 250 and v.max() < 70
