import glob
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import TINY, column
from pulsegrid.functions import distributions as ds
from pulsegrid.operators.detectors import vectors as vc
from pulsegrid.operators.detectors.base import Detector, PandasDetector, scored
from pulsegrid.operators.detectors.ensemble import Ensemble, detector_summary
from pulsegrid.operators.detectors.forecasting import ForecastInterval, forecast_tail, forecast_with
from pulsegrid.operators.detectors.learned import Autoencoder, IsolationForest
from pulsegrid.operators.detectors.statistical import Gesd, Iqr, SeasonalResidual, SlidingZScore, ZScore
from pulsegrid.operators.detectors.vectors import CentroidDistance, KnnDistance, LocalOutlierFactor
from pulsegrid.session import work_dir

SPIKES = [100, 200, 300, 400]


def flags(df):
    return np.flatnonzero(column(df, "is_anomaly"))


def score(df):
    return column(df, "score")


# --- distributions -----------------------------------------------------------

@pytest.mark.parametrize("p,df,expected", [
    (0.975, 1, 12.706204736), (0.975, 10, 2.228138852), (0.995, 30, 2.749995654),
    (0.95, 5, 2.015048373)])
def test_t_quantiles_against_tables(p, df, expected):
    assert ds.t_quantile(p, df) == pytest.approx(expected, rel=1e-6)


def test_t_quantile_of_many_degrees_by_expansion():
    z, v = ds.normal_quantile(0.9999), 1000.0
    near = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    assert ds.t_quantile(0.9999, v) == pytest.approx(near, rel=1e-7)


def test_t_and_normal_tails(spark):
    assert ds.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-7)
    assert ds.t_two_sided(0.0, 7) == 1.0
    got = spark.createDataFrame([(0.0,), (1.959963984540054,), (-1.0,)], "z double").select(ds.normal_tail(F.col("z")))
    assert [r[0] for r in got.collect()] == pytest.approx([0.5, 0.025, 0.8413447460685429])


def test_normal_tail_far_out(spark):
    z = [-40.0, -3.0, -0.1, 0.5, 2.4999, 2.5, 5.0, 12.0, 37.0, float("inf"), None]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(ds.normal_tail(F.col("z"))).collect()
    for x, (p,) in zip(z, got):
        assert p is None if x is None else p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-11, abs=1e-300)


def test_slope_p_value_for_few_and_many_rows(spark):
    rows = [(r2, n) for n in (2, 3, 4, 5, 6, 11, 60, 61, 62, 63, 200, 100_000) for r2 in (0.0, 1e-9, 1e-4, 0.03, 0.4, 0.97, 1.0)] + [(None, 9)]
    got = spark.createDataFrame(rows, "r2 double, n long").select("r2", "n", ds.slope_p_value(F.col("r2"), F.col("n")).alias("p")).collect()
    for r2, n, p in got:
        if r2 is None or n < 3:
            assert p is None
        else:
            want = 0.0 if r2 == 1 else ds.t_two_sided(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2)
            assert p == pytest.approx(want, abs=1e-9)


# --- statistical -------------------------------------------------------------

def test_zscore(series, spiky):
    got = ZScore().fit_detect(series(spiky))
    assert set(SPIKES) <= set(flags(got))
    np.testing.assert_allclose(score(got), np.abs(spiky - spiky.mean()) / spiky.std())


def test_zscore_missing_constant_and_unseen(series):
    got = ZScore().fit_detect(series([5, None, 5, 5]))
    assert score(got).tolist() == [0] * 4
    got = ZScore().detect(series([4.0]), ZScore().fit(series({"other": [1, 2, 3]})))
    assert score(got).tolist() == [4] and flags(got).tolist() == [0]     # mean 0, sd 1


@pytest.mark.parametrize("window", [20, 600])
def test_sliding_zscore(series, spiky, window):
    spiky[50] = np.nan
    got = score(SlidingZScore(window, layout=TINY).fit_detect(series(spiky)))
    want = np.zeros(500)
    for i, x in enumerate(spiky):
        near = spiky[max(0, i - window):i + 1] if window < 500 else spiky
        near = near[~np.isnan(near)]
        if not np.isnan(x) and len(near) > 1 and near.std() > 0:
            want[i] = abs(x - near.mean()) / near.std()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_iqr_fences(series, spiky):
    q1, q3 = np.quantile(spiky, [.25, .75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    got = Iqr().fit_detect(series(spiky))
    want = np.maximum(np.maximum(lo - spiky, spiky - hi), 0) / (q3 - q1)
    np.testing.assert_allclose(score(got), want, atol=1e-12)
    assert (flags(got) == np.flatnonzero(want > 0)).all()


def test_iqr_too_few_values(series):
    assert score(Iqr().fit_detect(series([1, 2, 5]))).tolist() == [0, .5, 3.5]   # fences +-1.5 around 0


def brute_gesd(v, limit=10, alpha=0.05):
    v = np.array(v, dtype=float)
    scores, hit = np.zeros(len(v)), np.zeros(len(v), bool)
    for k in range(1, min(limit, int((~np.isnan(v)).sum()) // 2) + 1):
        n = int((~np.isnan(v)).sum())
        if n < 3 or np.nanstd(v, ddof=1) == 0:
            break
        z = np.nan_to_num(np.abs(v - np.nanmean(v)) / np.nanstd(v, ddof=1))
        i = int(np.argmax(z))
        p = min(max(1 - alpha / (2 * (n - k + 1)), .5), .9999)
        t = ds.t_quantile(p, max(1, n - k - 1))
        limit_k = (n - k) * t / math.sqrt((n - k - 1 + t * t) * (n - k + 1))
        scores[i] = z[i]
        if z[i] <= limit_k:
            break
        hit[i], v[i] = True, np.nan
    return scores, hit


@pytest.mark.parametrize("n", [6, 40, 500])
def test_gesd_equals_full_rescans(series, spiky, n):
    v = spiky[:n].copy()
    v[n // 3], v[2] = 200, np.nan
    got = Gesd(layout=TINY).fit_detect(series({"a": v, "b": np.repeat([1.0, 2.0], n)}))
    want, hit = brute_gesd(v)
    a = got.filter("series_id = 'a'")
    np.testing.assert_allclose(score(a), want, rtol=1e-9)
    assert (column(a, "is_anomaly") == hit).all()
    np.testing.assert_allclose(score(got.filter("series_id = 'b'")), brute_gesd(np.repeat([1.0, 2.0], n))[0], rtol=1e-9)


def test_seasonal_residual(series):
    rng = np.random.default_rng(42)
    i = np.arange(200)
    v = 50 + 10 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 1, 200)
    v[100] += 40
    assert 100 in flags(SeasonalResidual(24, layout=TINY).fit_detect(series(v)))
    d = SeasonalResidual(layout=TINY)
    both = d.detect(series(v), d.fit(series(v)))
    np.testing.assert_allclose(score(both), score(d.fit_detect(series(v))), atol=1e-9)


# --- vectors -----------------------------------------------------------------

def windows(v, w=10):
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), w).copy()
    means = np.nanmean(x, axis=0)
    return np.where(np.isnan(x), means, x)


def test_window_vectors_with_missing(series, spiky):
    spiky[[30, 31, 200]] = np.nan
    got = vc.window_vectors(series(spiky), layout=TINY).orderBy("idx").select("vec").collect()
    np.testing.assert_allclose(np.array([r.vec for r in got]), windows(spiky))


def test_centroid(series, spiky):
    x = windows(spiky)
    d = np.linalg.norm(x - x.mean(axis=0), axis=1)
    got = CentroidDistance(layout=TINY).fit_detect(series({"s": spiky, "short": [1, 2, 3]}))
    s = got.filter("series_id = 's'")
    np.testing.assert_allclose(score(s), np.r_[np.zeros(9), d / d.max()], atol=1e-9)
    assert (flags(s) == 9 + np.flatnonzero(d > np.percentile(d, 95))).all()
    assert score(got.filter("series_id = 'short'")).tolist() == [0, 0, 0]


@pytest.fixture
def clumped():
    """Dense and sparse stretches, and a long run of equal windows."""
    rng = np.random.default_rng(9)
    return np.r_[rng.normal(0, 1, 150), rng.lognormal(2, 1, 100), np.full(120, 3.0), rng.normal(100, 30, 30)]


def distances(v, ref=None):
    x, y = windows(v), windows(v if ref is None else ref)
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


@pytest.mark.parametrize("bucket", [16, 64, 1024])
def test_nearest_neighbours_are_exact(series, clumped, monkeypatch, bucket):
    monkeypatch.setattr(vc, "BUCKET", bucket)
    d = distances(clumped)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :7]
    vectors = vc._self_vectors(series({"s": clumped, "t": clumped[::-1]}), 10, TINY)
    near = vc.nearest_neighbours(vectors.select("series_id", "vid", "vec", "is_query", "is_ref"), 7, 10)
    rows = near.filter("series_id = 's'").orderBy("vid").collect()
    np.testing.assert_allclose([[e.d for e in r.near] for r in rows], want, atol=1e-9)
    assert all(e.nid != r.vid for r in rows for e in r.near)


def test_neighbours_in_waves_keep_one_table(spark, frame, monkeypatch):
    """Many equal vectors and several waves: exact with ties to smaller ids, and no wave's table stays beside the last."""
    monkeypatch.setattr(vc, "BUCKET", 16)
    monkeypatch.setattr(vc, "WAVE_BYTES", 2000)
    x = np.random.default_rng(3).integers(0, 5, (300, 3)).astype(float)
    x[:60] = 2.0
    rows = frame(pd.DataFrame({"series_id": "s", "vid": np.arange(300), "vec": list(x)})).withColumns(
        {"is_query": F.lit(True), "is_ref": F.lit(True)})
    before = set(glob.glob(f"{work_dir(spark)}/pulsegrid/found-*"))
    got = {r.vid: [(e.d, e.nid) for e in r.near] for r in vc.nearest_neighbours(rows, 4, 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        best = np.lexsort((np.arange(300), d[i]))[:4]
        assert got[i] == [(d[i, j], j) for j in best]
    assert len(set(glob.glob(f"{work_dir(spark)}/pulsegrid/found-*")) - before) == 1


def test_waves_copy_only_the_blocks_of_their_series(frame, monkeypatch):
    """What is found for a series is written in the waves of its group, not in those of all series."""
    monkeypatch.setattr(vc, "BUCKET", 64)
    monkeypatch.setattr(vc, "WAVE_BYTES", 4000)
    copied, write = [], vc.written

    def counted(df, label="table"):
        out = write(df, label)
        copied.extend([out.count()] if label == "found" else [])
        return out

    monkeypatch.setattr(vc, "written", counted)
    x = {f"s{i}": np.random.default_rng(i).normal(0, 1, (60, 3)) for i in range(12)}
    rows = frame(pd.concat([pd.DataFrame({"series_id": s, "vid": np.arange(60), "vec": list(v)}) for s, v in x.items()]))
    near = vc.nearest_neighbours(rows.withColumns({"is_query": F.lit(True), "is_ref": F.lit(True)}), 4, 3).collect()
    assert len(near) == 720
    for r in near:
        d = np.sqrt(((x[r.series_id] - x[r.series_id][r.vid]) ** 2).sum(-1))
        d[r.vid] = np.inf
        assert [(e.d, e.nid) for e in r.near] == [(d[j], j) for j in np.lexsort((np.arange(60), d))[:4]]
    assert 12 <= sum(copied) <= 48


def test_rough_distances_lose_no_neighbour(frame, monkeypatch):
    """Clumps of very near vectors far from each other, and values too large for single precision."""
    monkeypatch.setattr(vc, "BUCKET", 16)
    rng = np.random.default_rng(5)
    close = np.concatenate([c + rng.integers(0, 8, (60, 3)) * 1e-4 for c in (0.0, 1e3, 1e6, -3e6)])
    x = {"far": close, "huge": np.concatenate([close[:120], rng.normal(0, 1e18, (60, 3))])}
    rows = frame(pd.concat([pd.DataFrame({"series_id": s, "vid": np.arange(len(v)), "vec": list(v)}) for s, v in x.items()]))
    for r in vc.nearest_neighbours(rows.withColumns({"is_query": F.lit(True), "is_ref": F.lit(True)}), 5, 3).collect():
        d = np.sqrt(((x[r.series_id] - x[r.series_id][r.vid]) ** 2).sum(-1))
        d[r.vid] = np.inf
        assert [(e.d, e.nid) for e in r.near] == [(d[j], j) for j in np.lexsort((np.arange(len(d)), d))[:5]]


def test_knn(series, clumped, monkeypatch):
    monkeypatch.setattr(vc, "BUCKET", 32)
    d = np.sort(distances(clumped), axis=1)
    own, with_self = d[:, 1:21].mean(1), d[:, :20].mean(1)
    got = KnnDistance(layout=TINY).fit_detect(series({"s": clumped, "few": clumped[:12], "one": [1.0] * 10}))
    s = got.filter("series_id = 's'")
    np.testing.assert_allclose(score(s), np.r_[np.zeros(9), with_self / with_self.max()], atol=1e-9)
    assert (flags(s) == 9 + np.flatnonzero(with_self > np.percentile(own, 95))).all()
    few = np.sort(distances(clumped[:12]), axis=1)[:, :2].mean(1)
    np.testing.assert_allclose(score(got.filter("series_id = 'few'")), np.r_[np.zeros(9), few / few.max()])


def test_knn_of_other_rows(series, clumped):
    train, test = clumped[:200], clumped[200:]
    det = KnnDistance(k=5, layout=TINY)
    got = det.detect(series(test), det.fit(series(train)))
    want = np.sort(distances(test, train), axis=1)[:, :5].mean(1)
    np.testing.assert_allclose(score(got), np.r_[np.zeros(9), want / want.max()], atol=1e-9)
    own = np.sort(distances(train), axis=1)[:, 1:6].mean(1)
    assert (flags(got) == 9 + np.flatnonzero(want > np.percentile(own, 95))).all()


def test_lof(series, spiky):
    d = distances(spiky)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :20]
    dn = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dn, dn[near, -1]).mean(1) + 1e-10)
    factor = density[near].mean(1) / density
    got = LocalOutlierFactor(layout=TINY).fit_detect(series(spiky))
    np.testing.assert_allclose(score(got), np.r_[np.zeros(9), factor / factor.max()], atol=1e-9)
    assert (flags(got) == 9 + np.flatnonzero(factor > np.percentile(factor, 95))).all()


def test_lof_in_waves_lists_no_neighbours(series, spiky, monkeypatch):
    """Densities go to the tasks in waves: the same factors, and no row for each neighbour."""
    lof = LocalOutlierFactor(layout=TINY)
    vectors = vc._self_vectors(series({"s": spiky, "t": spiky[::-1][:300]}), 10, TINY)
    want = {(r.series_id, r.vid): r.factor for r in lof.factors(vectors).collect()}
    monkeypatch.setattr(vc, "WAVE_BYTES", 3000)
    got = lof.factors(vectors)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.series_id, r.vid): r.factor for r in got.collect()}
    assert got.keys() == want.keys() and len(got) == 491 + 291
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


# --- learned -----------------------------------------------------------------

def test_isolation_forest_finds_spikes(series, spiky):
    got = IsolationForest(trees=40, layout=TINY).fit_detect(series(spiky))
    s, f = score(got), set(flags(got))
    assert s.min() == 0 and s.max() == 1
    assert all(f & set(range(i, i + 10)) for i in SPIKES)
    assert 0.02 < len(f) / 500 < 0.08
    again = IsolationForest(trees=40, layout=TINY).fit_detect(series(spiky).repartition(3))
    np.testing.assert_allclose(score(again), s)


def test_isolation_forest_on_other_rows(series, spiky):
    det = IsolationForest(trees=30, layout=TINY)
    params = det.fit(series(spiky))
    got = det.detect(series(np.r_[spiky[:60], 500.0, spiky[60:90]]), params)
    assert 60 in flags(got)


def brute_autoencoder(v, epochs=50, h=5, rate=0.01):
    x = windows(v)
    x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    n, d = x.shape
    rng = np.random.RandomState(42)
    w1 = rng.randn(d, h) * math.sqrt(2 / d)
    w2 = rng.randn(h, d) * math.sqrt(2 / h)
    b1, b2 = np.zeros(h), np.zeros(d)
    for _ in range(epochs):
        z = x @ w1 + b1
        a = np.maximum(z, 0)
        out = a @ w2 + b2
        e = out - x
        back = (e @ w2.T) * (z > 0)
        w2, b2, w1, b1 = w2 - rate * a.T @ e / n, b2 - rate * e.mean(0), w1 - rate * x.T @ back / n, b1 - rate * back.mean(0)
    limit = np.percentile((e ** 2).mean(1), 95)
    err = ((np.maximum(x @ w1 + b1, 0) @ w2 + b2 - x) ** 2).mean(1)
    return err, limit


def test_autoencoder_equals_whole_matrix_training(series, spiky):
    err, limit = brute_autoencoder(spiky, epochs=6)
    got = Autoencoder(epochs=6, layout=TINY).fit_detect(series(spiky))
    np.testing.assert_allclose(score(got), np.r_[np.zeros(9), err / err.max()], rtol=1e-8)
    assert (flags(got) == 9 + np.flatnonzero(err > limit)).all()


# --- forecasts ---------------------------------------------------------------

def one_step(past, window=20):
    past = past[~np.isnan(past)][-window:]
    if not len(past):
        return 0.0, 0.0
    slope = np.polyfit(np.arange(len(past)), past, 1)[0] if len(past) > 1 else 0.0
    return past[-1] + slope, (past.std() if len(past) > 1 else 1.0)


@pytest.mark.parametrize("baseline", [False, True])
def test_forecast_interval(series, spiky, baseline):
    v = spiky[:150].copy()
    v[40:75] = np.nan           # longer than the context below
    full = np.r_[v, v] if baseline else v
    skip = len(v) if baseline else 0
    z = ds.normal_quantile(0.975)
    want, hit = np.zeros(150), np.zeros(150, bool)
    for i, x in enumerate(v):
        at = skip + i
        if at < 20 or np.isnan(x):
            continue
        mean, sd = one_step(full[max(0, at - 30):at])
        want[i] = abs(x - mean) / max(z * sd, 0.5e-10)
        hit[i] = abs(x - mean) > z * sd
    det = ForecastInterval(context=30, layout=TINY)
    rows = series(v)
    got = det.fit_detect(rows) if baseline else det.detect(rows)
    np.testing.assert_allclose(score(got), want, rtol=1e-6, atol=1e-9)
    assert (column(got, "is_anomaly") == hit).all()


def test_forecast_tail(series):
    got = forecast_tail(series({"up": np.arange(30.0), "none": [None, None]}), 3).orderBy("series_id", "step").collect()
    assert [r["mean"] for r in got] == pytest.approx([0, 0, 0, 30, 31, 32])
    sd = np.arange(20).std()
    widths = [(r.upper - r.lower) / 2 for r in got[3:]]
    assert widths == pytest.approx([1.959963984540054 * sd * math.sqrt(1 + i / 3) for i in range(3)])


def test_forecast_noise_is_optional(series):
    rows = series(np.random.default_rng(0).normal(size=50))
    plain = column(forecast_tail(rows, 5), "mean", ("step",))
    assert (plain == column(forecast_tail(rows, 5), "mean", ("step",))).all()
    assert (plain != column(forecast_tail(rows, 5, noise_scale=0.1), "mean", ("step",))).any()


def test_custom_forecaster(series):
    def last(contexts, horizon, confidence):
        m = [[c[-1]] * horizon for c in contexts]
        return m, m, m
    got = forecast_with(series({"a": [1, 2, None], "b": [5]}), last, 2).orderBy("series_id", "step").collect()
    assert [r["mean"] for r in got] == [2, 2, 5, 5]


# --- ensembles ---------------------------------------------------------------

def test_strategies(series, spiky):
    rows = series(spiky)
    dets = [ZScore(3.0), Iqr(1.5), SlidingZScore(50, layout=TINY)]
    found = {s: set(flags(Ensemble(dets, s, 0.6).fit_detect(rows)))
             for s in ("majority", "unanimous", "any", "weighted", "threshold")}
    each = [set(flags(d.fit_detect(rows))) for d in dets]
    assert found["unanimous"] == set.intersection(*each)
    assert found["any"] == set.union(*each)
    votes = {i: sum(i in e for e in each) for i in found["any"]}
    assert found["majority"] == found["weighted"] == found["threshold"] == {i for i, n in votes.items() if n >= 2}


def test_weights_and_scores(series, spiky):
    rows = series(spiky)
    got = Ensemble([ZScore(3.0), Iqr(1.5)], "weighted", weights={"iqr": 3.0}).fit_detect(rows)
    assert set(flags(got)) == set(flags(Iqr().fit_detect(rows)))
    z, q = score(ZScore().fit_detect(rows)), score(Iqr().fit_detect(rows))
    np.testing.assert_allclose(score(got), (z / z.max() + 3 * q / q.max()) / 4)
    with pytest.raises(ValueError):
        Ensemble([ZScore()], "quorum")


def test_empty_ensemble_and_quiet_scores(series):
    assert score(Ensemble([]).detect(series([1, 2]))).tolist() == [0, 0]
    assert score(Ensemble([ZScore(), Iqr()]).fit_detect(series([4, 4, 4, 4, 4]))).tolist() == [0] * 5


def test_summary(series, spiky):
    s = detector_summary(Ensemble([ZScore(), Iqr()]).scores(series(spiky))).collect()
    assert {r.detector for r in s} == {"zscore", "iqr"}
    assert all(r.points == 500 and r.anomaly_count >= 4 and 0 < r.anomaly_ratio < 0.1 for r in s)


def test_custom_detectors(series, spiky):
    class Above(Detector):
        name = "above"

        def detect(self, rows, params=None):
            return scored(rows, self.name, F.col("value") - 70, F.col("value") > 70)

    def jump(pdf: pd.DataFrame):
        off = pdf["value"].diff().abs().fillna(0)
        return off, off > 20

    rows = series(spiky)
    assert set(flags(Above().fit_detect(rows))) >= set(SPIKES)
    got = PandasDetector("jump", jump, context=1, layout=TINY).fit_detect(rows)
    np.testing.assert_allclose(score(got), np.abs(np.diff(spiky, prepend=spiky[0])))
    both = Ensemble([Above(), PandasDetector("jump", jump, context=1, layout=TINY)], "unanimous").fit_detect(rows)
    assert set(flags(both)) >= set(SPIKES)


def test_fitted_tables_can_be_stored(spark, series, spiky, tmp_path):
    path = str(tmp_path / "params")
    Iqr().fit(series(spiky)).write.parquet(path)
    got = Iqr().detect(series([0.0, 50.0]), spark.read.parquet(path))
    assert flags(got).tolist() == [0]


def test_one_infinite_value_flags_no_series(series):
    from pulsegrid.operators.outliers import mark_outliers
    from pulsegrid.plans.detection import DetectionConfig, detect

    rows = series([np.inf if i == 50 else i % 7 for i in range(100)])
    for d, hits in ((ZScore(), 0), (SlidingZScore(10), 0), (Iqr(), 1), (SeasonalResidual(7), 0)):
        got = d.fit_detect(rows)
        assert got.filter("is_anomaly").count() == hits and got.filter("isnan(score)").isEmpty()
    assert [mark_outliers(rows, m).filter("is_outlier").count() for m in ("iqr", "zscore", "modified_zscore")] == [1, 0, 1]
    found = detect(rows, DetectionConfig(strategy="any", preprocess=None)).collect()
    assert [(r.seq, r.severity) for r in found] == [(50, 0)]


def test_scores_that_do_not_grow_outwards_are_scaled_by_their_own_largest(spark, series):
    from pulsegrid.operators.detectors.base import RowDetector

    class Near(RowDetector):
        name = "near"

        def fit(self, rows):
            return rows.groupBy("series_id").agg(F.lit(5.0).alias("at"))

        def score(self, value, params):
            return 1 / (1 + F.abs(value - params("at")))

        def flag(self, score):
            return score > 0.9

    rows = series([1, 5, 9])
    assert score(Ensemble([Near()]).fit_detect(rows)) == pytest.approx([0.2, 1.0, 0.2])
