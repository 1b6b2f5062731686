"""Name -> query.  Every query returns rounded, flat columns so results can be compared as values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions import labels as lab, scalar as sc
from pulsegrid.operators import (
    alerts as al, context as cx, counters as ct, forecast as fc, gaps as gp, maintenance as mt,
    normalize as nm, outliers as ot, resample as rs, seasonal as se, stats as st)
from pulsegrid.operators.detectors.base import PandasDetector
from pulsegrid.operators.detectors.ensemble import Ensemble, detector_summary
from pulsegrid.operators.detectors.forecasting import ForecastInterval, forecast_tail, forecast_with
from pulsegrid.operators.detectors.learned import Autoencoder, IsolationForest
from pulsegrid.operators.detectors.statistical import Gesd, Iqr, SeasonalResidual, SlidingZScore, ZScore
from pulsegrid.operators.detectors.vectors import CentroidDistance, KnnDistance, LocalOutlierFactor
from pulsegrid.plans import detection as dt
from pulsegrid.plans.preprocess import PreprocessConfig, preprocess, steps_applied
from pulsegrid.schema import micros
from pulsegrid.session import new_path, written
from pulsegrid.sources import files, outbox as ob, prometheus, serde, snmp, statsd, store
from pulsegrid.streaming import alerts as sa, metrics as sm, runs
from workload import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Value on a grid of ``digits`` decimals.

    Half steps go up with a thousandth of tolerance, so means of cents that lie
    exactly between two steps do not depend on the last bit.
    """
    col = F.col(c) if isinstance(c, str) else c
    scale = 10.0 ** digits
    return (F.floor(col * scale + 0.501) / scale).alias(name or (c if isinstance(c, str) else "value"))


def flag(c: str) -> Column:
    return F.col(c).cast("int").alias(c)


def scores_out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("series_id", "seq", r("score", digits), flag("is_anomaly"))


def values_out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("series_id", "seq", r("value", digits))


# --- catalogue, filters, labels ----------------------------------------------

@query
def catalog(spark, d):
    return store.catalog(tb.metrics(spark, d))


@query
def metric_names(spark, d):
    return store.names(tb.metrics(spark, d))


@query
def last_n_points(spark, d):
    return store.last_points(tb.events(spark, d), 1000).select("series_id", "seq", "value")


@query
def filter_name(spark, d):
    return store.by_name(tb.metrics(spark, d), "purchase").select("name", "seq", "value")


@query
def filter_label(spark, d):
    return store.by_label(tb.metrics(spark, d), "k", "5").select("name", "seq", "value")


@query
def fingerprint(spark, d):
    m = tb.metrics(spark, d)
    return m.select("seq", lab.alert_fingerprint(F.col("name"), F.col("labels")).alias("fingerprint"),
                    lab.label_fingerprint(F.col("name"), F.col("labels")).alias("series_key"))


@query
def extra_labels(spark, d):
    m = lab.with_labels(tb.metrics(spark, d), {"k": "override", "env": "prod"})
    return m.select("seq", lab.label_fingerprint(F.col("name"), F.col("labels")).alias("series_key"))


@query
def series_by_label(spark, d):
    m = tb.metrics(spark, d).select(
        lab.label_fingerprint(F.col("name"), F.map_filter("labels", lambda k, _: k == "k")).alias("series_id"), "value")
    return st.moments(m).select("series_id", "n", r("mean"), r("sd"), "vmin", "vmax")


@query
def enough_points(spark, d):
    m = tb.metrics(spark, d).withColumn("series_id", F.col("labels")["user"])
    return fc.with_enough_points(m, 60).select("series_id", "seq", "value")


@query
def too_few_points(spark, d):
    m = tb.metrics(spark, d).withColumn("series_id", F.col("labels")["user"])
    return fc.with_too_few_points(m, 60)


@query
def counter_names(spark, d):
    """Names made from event types, with counter and other endings."""
    e = tb.events(spark, d)
    name = F.concat("series_id", F.when(F.col("value") > 300, "_TOTAL").when(F.col("value") > 200, "_sum")
                    .when(F.col("value") > 100, "_Bytes_in").when(F.col("value") > 50, "_totals").otherwise("_usage"))
    return (e.select(name.alias("name"), sc.is_counter_name(name).cast("int").alias("is_counter"))
            .groupBy("name", "is_counter").agg(F.count("*").alias("n")))


# --- statistics --------------------------------------------------------------

@query
def series_moments(spark, d):
    return st.moments(tb.events(spark, d)).select("series_id", "n", r("mean"), r("sd"), "vmin", "vmax")


@query
def series_quantiles(spark, d):
    q = st.quantiles(tb.events(spark, d), {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99})
    return q.select("series_id", "n", *[r(c) for c in ("p01", "q1", "median", "q3", "p99")])


@query
def median_abs_deviation(spark, d):
    return st.mad(tb.events(spark, d)).select("series_id", "n", r("median"), r("mad"))


@query
def median_interval(spark, d):
    return st.median_interval(tb.events(spark, d)).select("series_id", r("interval"))


# --- counters, gaps, grids -----------------------------------------------------

@query
def counter_delta(spark, d):
    return values_out(ct.unwrap_counters(tb.order_counter(spark, d), bits=32), 2)


@query
def counter_delta_64(spark, d):
    """Increases in units of 2^32, for counters that start over at 2^64."""
    return values_out(ct.unwrap_counters(tb.order_counter(spark, d), bits=64).withColumn("value", F.col("value") / 2.0 ** 32))


@query
def counter_max_rate(spark, d):
    return values_out(ct.unwrap_counters(tb.order_counter(spark, d), bits=32, max_rate=40_000_000.0), 2)


@query
def counter_wraps(spark, d):
    return ct.counter_wraps(tb.order_counter(spark, d)).select("series_id", "seq", flag("wrapped"))


def _resampled(method: str) -> Query:
    def run(spark, d):
        h = tb.hourly(spark, d, method)
        return h.select("series_id", "seq", tb.us(), r("value"))
    return run


for _m in rs.METHODS:
    QUERIES[f"resample_hourly_{_m}"] = _resampled(_m)


@query
def resample_median(spark, d):
    """The default grid: one bin per median step."""
    return values_out(rs.resample_uniform(tb.events(spark, d)))


def _downsampled(method: str) -> Query:
    return lambda spark, d: values_out(rs.downsample(tb.events(spark, d), 10, method))


for _m in ("mean", "max", "min"):
    QUERIES[f"downsample_{_m}"] = _downsampled(_m)


@query
def gaps_detected(spark, d):
    return gp.detect_gaps(tb.events(spark, d)).select("series_id", "start_idx", "end_idx", r("duration"))


@query
def gaps_expected(spark, d):
    return gp.detect_gaps(tb.events(spark, d), 1200.0, 2.0).select("series_id", "start_idx", "end_idx", r("duration"))


def _filled(method: str, max_gap: float | None) -> Query:
    return lambda spark, d: values_out(gp.fill_gaps(tb.gappy(spark, d), method, max_gap))


for _m in ("linear", "ffill", "bfill", "zero"):
    QUERIES[f"fill_{_m}"] = _filled(_m, None)
for _m in ("linear", "ffill", "bfill"):
    QUERIES[f"fill_{_m}_maxgap"] = _filled(_m, 1800.0)


@query
def fill_hourly(spark, d):
    return values_out(gp.fill_gaps(tb.hourly(spark, d)))


@query
def quantiles_generated(spark, d):
    """Quartiles of one-minute grids, on which the long gaps between events are filled: many times as many rows as are read."""
    grid = gp.fill_gaps(rs.resample_uniform(tb.events(spark, d), 60.0))
    q = st.quantiles(grid, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("series_id", "n", *[r(c, 5) for c in ("q1", "median", "q3")])


# --- outliers, normalisation -----------------------------------------------------

def _outliers(method: str) -> Query:
    return lambda spark, d: ot.mark_outliers(tb.events(spark, d), method).select("series_id", "seq", flag("is_outlier"))


for _name, _m in (("iqr", "iqr"), ("zscore", "zscore"), ("mad", "modified_zscore")):
    QUERIES[f"outliers_{_name}"] = _outliers(_m)


@query
def clip(spark, d):
    return values_out(ot.clip_outliers(tb.events(spark, d)))


def _replaced(replacement: str) -> Query:
    return lambda spark, d: values_out(ot.replace_outliers(tb.events(spark, d), "iqr", replacement))


for _m in ot.REPLACEMENTS:
    QUERIES[f"replace_{_m}"] = _replaced(_m)


@query
def norm_z(spark, d):
    return values_out(nm.z_normalize(tb.events(spark, d)))


@query
def norm_minmax(spark, d):
    return values_out(nm.minmax_normalize(tb.events(spark, d), feature_range=(-1.0, 1.0)))


@query
def norm_robust(spark, d):
    return values_out(nm.robust_normalize(tb.events(spark, d)))


@query
def norm_log(spark, d):
    return values_out(nm.log_normalize(tb.events(spark, d), 2.0))


_SPLIT = "ts < timestamp '2024-01-16'"


@query
def norm_saved(spark, d):
    """Parameters of the first half of the month applied to the second."""
    e = tb.events(spark, d)
    return values_out(nm.z_normalize(e.filter(f"not ({_SPLIT})"), nm.fit_zscore(e.filter(_SPLIT))))


# --- season --------------------------------------------------------------------

@query
def moving_average_24(spark, d):
    out = se.moving_average(tb.hourly(spark, d), 24)
    return out.select("series_id", "seq", r("trend"))


@query
def period_estimate(spark, d):
    return se.estimate_period(tb.hourly(spark, d))


@query
def period_long(spark, d):
    """All events as one series, searched in bands that its length exceeds."""
    whole = tb.events(spark, d).withColumn("series_id", F.lit("all"))
    return se.estimate_period(whole, band=1 << 12)


def _parts(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("series_id", "seq", "period", r("trend", digits), r("seasonal", digits), r("residual", digits))


@query
def decompose_add(spark, d):
    return _parts(se.seasonal_decompose(tb.hourly(spark, d), 24))


@query
def decompose_mult(spark, d):
    return _parts(se.seasonal_decompose(tb.hourly(spark, d), 24, "multiplicative"))


@query
def decompose_estimated(spark, d):
    return _parts(se.seasonal_decompose(tb.hourly(spark, d)))


# --- detectors -----------------------------------------------------------------

@query
def detect_zscore(spark, d):
    return scores_out(ZScore().fit_detect(tb.events(spark, d)))


@query
def detect_zscore_window(spark, d):
    return scores_out(SlidingZScore(50).fit_detect(tb.events(spark, d)))


@query
def detect_infinite(spark, d):
    """Two of the series hold infinite values: their deviations are undefined and flag nothing, their fences still work."""
    odd = F.col("series_id").isin("click", "error") & (F.col("seq") % 97 == 0)
    rows = tb.events(spark, d).withColumn("value", F.when(odd, F.lit(float("inf"))).otherwise(F.col("value")))
    finite = F.when(F.abs("score") < float("inf"), F.col("score"))
    parts = [x.fit_detect(rows).select("series_id", "seq", "detector", r(finite, 6, "score"), flag("is_anomaly"))
             for x in (ZScore(), Iqr())]
    marked = ot.outliers_zscore(rows).select(
        "series_id", "seq", F.lit("mask").alias("detector"), F.lit(None).cast("double").alias("score"),
        F.col("is_outlier").cast("int").alias("is_anomaly"))
    return parts[0].unionByName(parts[1]).unionByName(marked)


@query
def detect_iqr(spark, d):
    return scores_out(Iqr().fit_detect(tb.events(spark, d)))


@query
def detect_gesd(spark, d):
    return scores_out(Gesd().fit_detect(tb.events(spark, d)))


@query
def detect_stl(spark, d):
    return scores_out(SeasonalResidual(24).fit_detect(tb.hourly(spark, d)))


@query
def detect_stl_estimated(spark, d):
    return scores_out(SeasonalResidual().fit_detect(tb.hourly(spark, d)))


@query
def detect_centroid(spark, d):
    return scores_out(CentroidDistance().fit_detect(tb.events(spark, d)))


@query
def detect_knn(spark, d):
    return scores_out(KnnDistance().fit_detect(tb.events(spark, d)))


@query
def detect_lof(spark, d):
    return scores_out(LocalOutlierFactor().fit_detect(tb.events(spark, d)))


@query
def detect_forecast_interval(spark, d):
    return scores_out(ForecastInterval().detect(tb.events(spark, d)), 4)


@query
def detect_forecast_interval_baseline(spark, d):
    """The series in front of itself, so even its first rows have a past."""
    return scores_out(ForecastInterval().fit_detect(tb.events(spark, d)), 4)


@query
def isolation_forest(spark, d):
    return scores_out(IsolationForest().fit_detect(tb.events(spark, d)))


@query
def autoencoder(spark, d):
    return scores_out(Autoencoder().fit_detect(tb.events(spark, d)), 4)


@query
def detect_custom(spark, d):
    """A plugged-in detector: distance from the median of the last 5 rows."""
    def fn(pdf):
        mid = pdf["value"].rolling(5, min_periods=1).median()
        off = (pdf["value"] - mid).abs()
        return off, off > 150
    return scores_out(PandasDetector("median5", fn, context=4).detect(tb.events(spark, d)))


@query
def detect_trained(spark, d):
    """Fitted on the first half of the month, applied to the second."""
    e = tb.events(spark, d)
    return scores_out(Iqr().detect(e.filter(f"not ({_SPLIT})"), Iqr().fit(e.filter(_SPLIT))))


# --- ensembles, pipeline -----------------------------------------------------

def _three() -> list:
    return [ZScore(), Iqr(), SlidingZScore(50)]


def _ensemble(strategy: str, threshold: float = 0.5, weights: dict | None = None) -> Query:
    def run(spark, d):
        out = Ensemble(_three(), strategy, threshold, weights).fit_detect(tb.events(spark, d))
        return out.select("series_id", "seq", r("score"), flag("is_anomaly"), "votes")
    return run


for _m in ("majority", "unanimous", "any"):
    QUERIES[f"ensemble_{_m}"] = _ensemble(_m)
QUERIES["ensemble_weighted"] = _ensemble("weighted", weights={"zscore": 1.0, "iqr": 3.0})
QUERIES["ensemble_threshold"] = _ensemble("threshold", 0.6)


@query
def detector_report(spark, d):
    s = detector_summary(Ensemble([ZScore(), Iqr()]).scores(tb.events(spark, d)))
    return s.select("series_id", "detector", "points", "anomaly_count", r("anomaly_ratio"), r("max_score"))


def _anomalies_out(df: DataFrame) -> DataFrame:
    return df.select("series_id", "seq", tb.us(), r("value"), r("score"), "severity",
                     F.array_join("detectors", ",").alias("detectors"))


_RAW = dt.DetectionConfig(preprocess=None)


@query
def detect_ensemble(spark, d):
    return _anomalies_out(dt.detect(tb.events(spark, d), _RAW))


@query
def detect_default(spark, d):
    """With the default cleaning, which replaces outliers before detection."""
    return _anomalies_out(dt.detect(tb.events(spark, d)))


@query
def detect_any(spark, d):
    clean = PreprocessConfig(handle_outliers=False)
    return _anomalies_out(dt.detect(tb.gappy(spark, d), dt.DetectionConfig(strategy="any", preprocess=clean)))


@query
def detect_by_gesd(spark, d):
    found = dt.detect(tb.events(spark, d), dt.DetectionConfig(detectors=dt.by_method("gesd"), preprocess=None))
    return _anomalies_out(found)


@query
def detect_context(spark, d):
    cfg = dt.DetectionConfig(preprocess=None, use_context=True)
    return _anomalies_out(dt.detect(tb.events(spark, d), cfg))


@query
def detection_overview(spark, d):
    e = tb.events(spark, d)
    return dt.detection_summary(e, dt.detect(e, _RAW))


@query
def anomaly_rollup(spark, d):
    return dt.severity_rollup(dt.detect(tb.events(spark, d), _RAW))


@query
def top_anomalies(spark, d):
    return _anomalies_out(store.top_anomalies(dt.detect(tb.events(spark, d), _RAW), 10))


@query
def preprocess_series(spark, d):
    cfg = PreprocessConfig(resample=True, resample_interval=3600.0, normalize=True)
    return values_out(preprocess(tb.events(spark, d), cfg))


@query
def preprocess_counters(spark, d):
    c = tb.order_counter(spark, d).withColumn("series_id", F.concat("series_id", F.lit("_total")))
    return values_out(preprocess(c, PreprocessConfig(counter_bits=32, outlier_replacement="clip")), 2)


@query
def preprocess_steps(spark, d):
    c = tb.events(spark, d).withColumn("series_id", F.when(F.col("value") > 100, F.concat("series_id", F.lit("_total")))
                                       .otherwise(F.col("series_id")))
    return steps_applied(c).select("series_id", F.array_join("steps", ",").alias("steps"))


@query
def temporal_context(spark, d):
    e = cx.with_temporal_context(tb.events(spark, d))
    return e.select("seq", "hour", "day_of_week", flag("is_weekend"), flag("is_business_hours"),
                    sc.threshold_multiplier(F.col("ts")).alias("multiplier"))


@query
def temporal_context_zone(spark, d):
    e = cx.with_temporal_context(tb.events(spark, d), zone="Europe/Berlin")
    return e.select("seq", "hour", "day_of_week", flag("is_weekend"), flag("is_business_hours"),
                    sc.iso_time(F.col("ts"), "Europe/Berlin").alias("local"))


@query
def severity_matrix(spark, d):
    """Severity over every combination of score, duration, type and correlation the events give."""
    e = tb.table(spark, d, "events")
    kind = (F.when(F.col("event_type") == "error", "ERROR_RATE").when(F.col("event_type") == "click", "oom")
            .otherwise(F.col("event_type")))
    level = sc.severity(F.col("value") / 200, F.col("user_id").cast("double"), kind, F.col("event_id") % 2 == 0)
    return e.select("event_id", level.alias("severity"), sc.severity_label(level).alias("label"))


@query
def severity_symbols(spark, d):
    """The symbol of each event's severity; of levels that there are not, the unknown one."""
    graded = QUERIES["severity_matrix"](spark, d)
    return graded.select("event_id", sc.severity_emoji(F.col("severity")).alias("symbol"),
                         sc.severity_emoji(F.col("severity") + 3).alias("beyond"))


@query
def correlated_metrics(spark, d):
    found = cx.correlated_metrics(dt.detect(tb.events(spark, d), _RAW), 300.0)
    return found.select("metric", "component", "size")


@query
def regraded(spark, d):
    """Anomalies graded again with correlation."""
    found = written(dt.detect(tb.events(spark, d), _RAW), "anomalies")
    out = dt.regrade(found, correlated=cx.correlated_metrics(found, 300.0))
    return out.select("series_id", "seq", "severity")


# --- forecasting -------------------------------------------------------------

@query
def forecast_points(spark, d):
    points, _ = fc.forecast(tb.daily_revenue(spark, d), horizon=60)
    return points.select("series_id", "step", tb.us(), r("predicted", 2), r("lower", 2), r("upper", 2))


@query
def forecast_summary(spark, d):
    _, summary = fc.forecast(tb.cumulative_lines(spark, d), horizon=30, capacity_threshold=1_000_000.0)
    return summary.select("series_id", "confidence", r("trend_slope", 10), r("days_to_exhaustion", 3),
                          F.substring("exhaustion_date", 1, 10).alias("exhaustion_day"), "n_points")


@query
def sla_risk(spark, d):
    _, summary = fc.forecast(tb.daily_revenue(spark, d), horizon=60, sla_threshold=500_000.0)
    return summary.select("series_id", r("sla_risk_score"))


@query
def trend_summary(spark, d):
    t = fc.trend_summary(tb.daily_revenue(spark, d))
    return t.select("series_id", "status", r("slope", 4), r("r_squared", 8), "direction",
                    r("current_value", 2), r("mean", 2), r("sd", 2))


@query
def trend_pvalue(spark, d):
    t = fc.trend_summary(tb.daily_revenue(spark, d))
    return t.select("series_id", r("p_value", 8), flag("significant"))


@query
def forecast_recent(spark, d):
    out = forecast_tail(tb.events(spark, d), 12)
    return out.select("series_id", "step", r("mean", 4), r("lower", 4), r("upper", 4))


@query
def forecast_custom(spark, d):
    """A plugged-in forecaster: the mean of the last 100 values."""
    def flat(contexts, horizon, confidence):
        means = [[sum(c) / len(c)] * horizon for c in contexts]
        return means, [[min(c)] * horizon for c in contexts], [[max(c)] * horizon for c in contexts]
    out = forecast_with(tb.events(spark, d), flat, 3)
    return out.select("series_id", "step", r("mean", 6), r("lower"), r("upper"))


# --- alerts ------------------------------------------------------------------

def _alerts_out(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "fingerprint", "metric_name", "severity", "state", micros(F.col("first_seen")).alias("first_us"),
        micros(F.col("last_seen")).alias("last_us"), "count", r("value"), r("score"), "message",
        flag("is_current"))


@query
def alert_episodes(spark, d):
    return _alerts_out(al.episodes(tb.fires(spark, d)))


@query
def alert_silenced(spark, d):
    return al.silenced(tb.fires(spark, d), tb.silences(spark, d)).select("fingerprint", "seq")


@query
def alert_lifecycle(spark, d):
    """Fires, silences, acknowledgements and resolutions together."""
    return _alerts_out(al.episodes(tb.fires(spark, d), silences=tb.silences(spark, d), commands=tb.commands(spark, d)))


@query
def alert_active(spark, d):
    runs_ = al.episodes(tb.fires(spark, d), silences=tb.silences(spark, d), commands=tb.commands(spark, d))
    return al.active_alerts(runs_).select("fingerprint", "metric_name", "state", "count")


@query
def alert_history(spark, d):
    runs_ = al.episodes(tb.fires(spark, d), commands=tb.commands(spark, d))
    return al.history(runs_).select("id", "count", r("duration_minutes"))


@query
def alert_escalated(spark, d):
    runs_ = al.episodes(tb.fires(spark, d), dedup_seconds=2400.0)
    return al.escalate(runs_, tb.ticks(spark, d)).select("id", "severity")


@query
def alert_from_anomalies(spark, d):
    """Anomalies outside maintenance as alerts."""
    runs_ = dt.alerts_for(dt.detect(tb.events(spark, d), _RAW), tb.windows(spark, d))
    return _alerts_out(runs_)


@query
def health(spark, d):
    runs_ = al.episodes(tb.fires(spark, d), commands=tb.commands(spark, d))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return al.health(runs_, mt.active_windows(tb.windows(spark, d), now))


@query
def alert_outbox(spark, d):
    box = ob.outbox(al.episodes(tb.fires(spark, d), commands=tb.commands(spark, d)), title="Ops")
    pick = lambda path: F.get_json_object("payload", path)
    return box.select(
        "channel", "dedup_key", pick("$.id").alias("id"), pick("$.subject").alias("subject"),
        pick("$.attachments[0].color").alias("color"), pick("$.attachments[0].fields[0].value").alias("shown_value"),
        pick("$.event_action").alias("event_action"), pick("$.payload.severity").alias("pager_severity"))


# --- maintenance ---------------------------------------------------------------

def _labelled(spark, d) -> DataFrame:
    return tb.metrics(spark, d).withColumn("series_id", F.col("name"))


@query
def maintenance_suppressed(spark, d):
    return mt.suppressed(_labelled(spark, d), tb.windows(spark, d), labels="labels").select("series_id", "seq")


@query
def maintenance_survivors(spark, d):
    return mt.not_suppressed(_labelled(spark, d), tb.windows(spark, d), labels="labels").select("series_id", "seq")


@query
def maintenance_matches(spark, d):
    return mt.suppressing(_labelled(spark, d), tb.windows(spark, d), labels="labels").select("seq", "window_id")


@query
def maintenance_many_targets(spark, d):
    """A window per customer, hours to a day long, with targets of its own."""
    w = tb.windows(spark, d).withColumns({
        "targets": F.array(F.col("id"), F.concat(F.lit("ic"), F.col("id")), F.substring("name", -2, 2)),
        "end_ts": F.timestamp_micros(micros(F.col("start_ts")) + (F.col("id").cast("bigint") % 24 + 1) * 3_600_000_000)})
    return mt.suppressing(_labelled(spark, d), w, labels="labels").select("seq", "window_id")


@query
def maintenance_long_windows(spark, d):
    """Windows of minutes to decades in one table."""
    w = tb.windows(spark, d)
    k = F.col("id").cast("bigint")
    back = F.when(k % 3 == 0, k % 40 * 31_536_000).when(k % 3 == 1, k % 50 * 86_400).otherwise(0) * 1_000_000
    w = w.withColumn("start_ts", F.timestamp_micros(micros(F.col("start_ts")) - back))
    hits = mt.suppressing(tb.events(spark, d), w)
    return hits.groupBy("seq").agg(F.count("*").alias("windows"), F.min(F.col("window_id").cast("bigint")).alias("first_window"))


_NOW = "2024-01-15 12:00:00"


@query
def maintenance_due(spark, d):
    w = tb.windows(spark, d)
    reported = w.filter("created_by = 'BUILDING'").select("id")
    return mt.recalibration_due(w, F.lit(_NOW).cast("timestamp"), reported).select("id", "name")


@query
def maintenance_listing(spark, d):
    out = mt.list_windows(tb.windows(spark, d), F.lit(_NOW).cast("timestamp"))
    return out.select("id", flag("is_active"), r("duration_minutes"))


@query
def maintenance_json(spark, d):
    """Fields of the JSON texts of all windows."""
    texts = serde.windows_to_json(tb.windows(spark, d), F.lit(_NOW).cast("timestamp"))
    w = F.from_json("json", "id string, start_time double, end_time double, targets array<string>, recalibrate boolean, is_active boolean, "
                            "duration_minutes double")
    return texts.select(w.alias("w")).select(
        "w.id", r("w.start_time", 3, "start_time"), r("w.end_time", 3, "end_time"), F.size("w.targets").cast("bigint").alias("targets"),
        F.col("w.recalibrate").cast("int").alias("recalibrate"), F.col("w.is_active").cast("int").alias("is_active"),
        r("w.duration_minutes", name="duration_minutes"))


@query
def maintenance_expired(spark, d):
    return mt.expired(tb.windows(spark, d), F.lit(_NOW).cast("timestamp")).select("id")


@query
def maintenance_refit(spark, d):
    """Means refitted on the rows after the last window that touched a series."""
    e = tb.events(spark, d)
    due = mt.recalibration_due(tb.windows(spark, d), F.lit(_NOW).cast("timestamp"))
    return st.moments(mt.rows_after_maintenance(e, due)).select("series_id", "n", r("mean"), r("sd"))


@query
def maintenance_changes(spark, d):
    """Windows after a log of changes: orders put or delete the window of their customer."""
    o = tb.table(spark, d, "orders")
    log = o.select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("action"),
        F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("name"),
        F.lit(None).cast("timestamp").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"),
        F.lit(None).cast("array<string>").alias("targets"), F.lit(None).cast("boolean").alias("recalibrate"),
        F.lit(None).cast("string").alias("created_by"))
    out = mt.apply_changes(tb.windows(spark, d), log)
    return out.select("id", "name", micros(F.col("start_ts")).alias("start_us"), micros(F.col("end_ts")).alias("end_us"))


# --- sources and sinks ---------------------------------------------------------

def _epoch_ms() -> Column:
    return F.floor(micros(F.col("ts")) / 1000).cast("bigint")


@query
def prom_parse(spark, d):
    """Events written as exposition lines, among comments and broken lines, and read back."""
    m = tb.metrics(spark, d)
    good = F.format_string('%s{user="%s",k="%s",seq="%d"} %s %d', "name", F.col("labels")["user"], F.col("labels")["k"],
                           F.col("seq"), F.col("value").cast("string"), _epoch_ms())
    lines = m.select(F.explode(F.array(
        good, F.concat(F.lit("# HELP "), "name"), F.concat("name", F.lit(" 12abc")), F.lit(""))).alias("value"))
    path = new_path(spark, "exposition")
    lines.write.text(path)
    p = prometheus.read_exposition(spark, path, {"env": "prod"})
    return p.select("name", r("value"), tb.us(), F.col("labels")["user"].alias("user_label"),
                    F.col("labels")["k"].alias("k"), F.col("labels")["seq"].cast("bigint").alias("seq"),
                    F.col("labels")["env"].alias("env"))


@query
def statsd_parse(spark, d):
    m = tb.metrics(spark, d)
    kind = F.when(F.col("name") == "click", "c").when(F.col("name") == "view", "g").when(
        F.col("name") == "error", "ms").otherwise("x")
    good = F.concat("name", F.lit(":"), F.col("value").cast("string"), F.lit("|"), kind, F.lit("|@0.5|#seq:"),
                    F.col("seq").cast("string"), F.lit(",user:"), F.col("labels")["user"], F.lit(",flagged"))
    lines = m.select(F.explode(F.array(good, F.concat("name", F.lit(" no colon")), F.concat("name", F.lit(":1")))).alias("value"))
    p = statsd.parse_statsd(lines, received=F.current_timestamp())
    return p.select("name", r("value"), F.col("labels")["type"].alias("type"), F.col("labels")["user"].alias("user_label"),
                    F.col("labels")["seq"].cast("bigint").alias("seq"), F.col("labels")["flagged"].alias("flagged"))


@query
def snmp_parse(spark, d):
    p = snmp.parse_samples(tb.device_samples(spark, d), bits=32)
    return p.select("name", "seq", r("value", 1), "unit", "source", F.col("labels")["host"].alias("host"),
                    F.col("labels")["ifIndex"].alias("if_index"), F.col("labels")["site"].alias("site"))


@query
def csv_roundtrip(spark, d):
    """Events written as CSV, some with unusable values, and read back with labels."""
    m = tb.metrics(spark, d)
    path = new_path(spark, "csv")
    m.select("name", F.when(F.col("value") < 5, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
             (micros(F.col("ts")) / 1e6).cast("decimal(20,6)").cast("string").alias("timestamp"),
             F.col("labels")["user"].alias("user"), F.col("seq").cast("string").alias("seq"),
             F.when(F.col("value") > 50, "high").alias("band")).write.option("header", True).csv(path)
    back = files.read_metrics(spark, path, "csv", labels={"env": "prod", "band": "low"})
    return back.select("name", r("value"), tb.us(), F.col("labels")["user"].alias("user_label"),
                       F.col("labels")["seq"].cast("bigint").alias("seq"), F.col("labels")["band"].alias("band"),
                       F.col("labels")["env"].alias("env"))


@query
def csv_mixed_headers(spark, d):
    """Files whose columns stand in different order, with quotes and commas in a label."""
    m = tb.metrics(spark, d)
    at = (micros(F.col("ts")) / 1e6).cast("decimal(20,6)").cast("string").alias("timestamp")
    note = F.concat(F.lit('say "'), F.col("labels")["user"], F.lit('", ok')).alias("note")
    seq = F.col("seq").cast("string").alias("seq")
    path = new_path(spark, "csv-mixed")
    for part, cols in (("a", ["name", "value", at, seq, note]), ("b", [note, seq, "value", "name", at])):
        (m.filter(F.col("seq") % 2 == ("ab".index(part))).select(*cols)
         .write.option("header", True).option("escape", '"').csv(f"{path}/{part}"))
    back = files.read_csv(spark, [f"{path}/a", f"{path}/b"])
    return back.select("name", r("value"), tb.us(), F.col("labels")["note"].alias("note"),
                       F.col("labels")["seq"].cast("bigint").alias("seq"))


@query
def json_roundtrip(spark, d):
    """One JSON document per user, each an object with a list of metrics."""
    m = tb.metrics(spark, d)
    entry = F.struct(F.when(F.col("value") >= 5, F.col("name")).alias("name"), "value",
                     (micros(F.col("ts")) / 1e6).cast("decimal(20,6)").alias("timestamp"),
                     F.map_concat("labels", F.create_map(F.lit("seq"), F.col("seq").cast("string"))).alias("labels"))
    path = new_path(spark, "json")
    (m.withColumn("user", F.col("labels")["user"]).groupBy("user", F.to_date("ts").alias("day"))
     .agg(F.collect_list(entry).alias("metrics"))
     .select("metrics").write.json(path))
    back = files.read_json(spark, path, {"env": "prod"}, lines=True)
    return back.select("name", r("value"), tb.us(), F.col("labels")["user"].alias("user_label"),
                       F.col("labels")["seq"].cast("bigint").alias("seq"), F.col("labels")["env"].alias("env"))


@query
def json_one_document(spark, d):
    """All events as one JSON array in one file, read by as many tasks as it has blocks."""
    m = tb.metrics(spark, d)
    entry = F.to_json(F.struct(
        F.when(F.col("value") >= 5, F.col("name")).alias("name"), "value", (micros(F.col("ts")) / 1e6).cast("decimal(20,6)").alias("timestamp"),
        F.map_concat("labels", F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("note"), F.lit('a } "]" {'))).alias("labels")))
    head, tail = (spark.range(1).select(F.lit(t).alias("value")) for t in ('["first"', "]"))
    path = new_path(spark, "json-document")
    head.unionAll(m.select(F.concat(F.lit(", "), entry))).unionAll(tail).coalesce(1).write.text(path)
    back = files.read_json(spark, path, {"env": "prod"}, split=True)
    return back.select("name", r("value"), tb.us(), F.col("labels")["user"].alias("user_label"),
                       F.col("labels")["seq"].cast("bigint").alias("seq"), F.col("labels")["note"].alias("note"))


@query
def format_auto(spark, d):
    """Events with odd numbers as CSV, the others as JSON documents of a user each, read by the suffix of their folders."""
    m = tb.metrics(spark, d).withColumn("timestamp", (micros(F.col("ts")) / 1e6).cast("decimal(20,6)").cast("string"))
    path = new_path(spark, "auto")
    m.filter("seq % 2 = 1").select("name", "value", "timestamp", F.col("seq").cast("string").alias("seq")).write.csv(f"{path}/m.csv", header=True)
    entry = F.struct("name", "value", "timestamp", F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("labels"))
    (m.filter("seq % 2 = 0").groupBy(F.col("labels")["user"]).agg(F.collect_list(entry).alias("metrics")).select("metrics")
     .write.json(f"{path}/m.json"))
    back = files.union_metrics(files.read_metrics(spark, f"{path}/m.csv"), files.read_metrics(spark, f"{path}/m.json", lines=True))
    return back.select("name", r("value"), tb.us(), F.col("labels")["seq"].cast("bigint").alias("seq"))


@query
def store_ingest(spark, d):
    """Events as JSON payloads appended to the store; the catalogue is read from it."""
    m = tb.metrics(spark, d)
    payloads = m.select(F.to_json(F.struct(
        F.when(F.col("value") >= 5, F.col("name")).otherwise("").alias("name"), "value",
        (micros(F.col("ts")) / 1e6).alias("timestamp"), "labels")).alias("value"))
    path = new_path(spark, "store")
    n = store.append(store.parse_payloads(payloads), path)
    return store.catalog(store.read_store(spark, path)).withColumn("ingested", F.lit(n).cast("bigint"))


@query
def metrics_serde(spark, d):
    m = tb.metrics(spark, d)
    back = serde.metrics_from_json(serde.metrics_to_json(m))
    return back.select("name", r("value"), tb.us(), F.col("labels")["user"].alias("user_label"), "source", "unit")


@query
def anomaly_sink(spark, d):
    found = dt.detect(tb.events(spark, d), _RAW).select(
        F.col("series_id").alias("metric_name"), "ts", "value", "score", "severity", "detectors",
        lab.literal_labels(None).alias("labels"))
    path = new_path(spark, "anomalies")
    store.write_anomalies(serde.anomalies_to_json(found), path, "text")
    back = serde.anomalies_from_json(spark.read.text(path), "value")
    return back.select("metric_name", tb.us(), r("value"), r("score"), "severity")


@query
def union_batches(spark, d):
    m = tb.metrics(spark, d)
    both = files.union_metrics(m.filter("value > 100"), m.filter("value <= 100").drop("unit"))
    return both.groupBy("name", "unit").agg(F.count("*").alias("points"), r(F.sum("value"), 2, "total"))


# --- streams -----------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, d) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = runs.stream_parquet(spark, d, _EVENTS, only="events.parquet")
    return raw.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("event_id").alias("seq"), "value")


@query
def stream_resample(spark, d):
    """Hourly means of rows that come in four parts, each row up to 20 hours late."""
    out = runs.run_in_turn(tb.in_turn(tb.events(spark, d)), lambda rows: sm.resample_stream(rows, "1 hour", "1 day"), "resample")
    return out.select("series_id", micros(F.col("bin_start")).alias("bin_us"), r("value"))


@query
def stream_resample_closed(spark, d):
    """Hourly means of all bins; a closing row far in the future lets the watermark pass the last."""
    out = runs.run_closed(_event_stream(spark, d), lambda rows: sm.resample_stream(rows, "1 hour", "1 hour"), "resample")
    return out.select("series_id", micros(F.col("bin_start")).alias("bin_us"), r("value"))


@query
def stream_sliding(spark, d):
    """Statistics of six hours every two hours, of rows that come in four parts, each row up to 20 hours late."""
    out = runs.run_in_turn(tb.in_turn(tb.events(spark, d)), lambda rows: sm.sliding_stats(rows, "6 hours", "2 hours", "1 day"), "sliding")
    return out.select("series_id", micros(F.col("span_start")).alias("span_us"), "n", r("mean"), r("sd"))


@query
def stream_sliding_closed(spark, d):
    """All spans, with a closing row."""
    out = runs.run_closed(_event_stream(spark, d), lambda rows: sm.sliding_stats(rows, "6 hours", "2 hours", "1 hour"), "sliding")
    return out.select("series_id", micros(F.col("span_start")).alias("span_us"), "n", r("mean"), r("sd"))


@query
def stream_zscore(spark, d):
    """Scores against the 50 rows before in event time, of rows that come in four parts, each row up to 20 hours late."""
    out = runs.run_in_turn(tb.in_turn(tb.events(spark, d)), lambda rows: sm.sliding_scores(rows, 50, "1 day"), "zscore")
    return out.select("series_id", "seq", r("score"))


@query
def stream_scored(spark, d):
    z = ZScore()
    params = written(z.fit(tb.events(spark, d)), "params")
    return scores_out(runs.run_available(sm.score_stream(_event_stream(spark, d), z, params), "scored"))


@query
def stream_suppressed(spark, d):
    kept = sm.suppress_stream(_event_stream(spark, d), written(tb.windows(spark, d), "windows"))
    return runs.run_available(kept, "suppressed").select("series_id", "seq")


@query
def stream_statsd(spark, d):
    m = tb.metrics(spark, d)
    lines = m.select(F.concat("name", F.lit(":"), F.col("value").cast("string"), F.lit("|c|@0.25|#seq:"),
                              F.col("seq").cast("string")).alias("value"))
    path = new_path(spark, "statsd")
    lines.write.text(path)
    out = runs.run_available(sm.statsd_intake(runs.stream_text(spark, path)), "statsd")
    return out.select("name", r("value"), F.col("labels")["seq"].cast("bigint").alias("seq"))


@query
def stream_counters(spark, d):
    """Increases of counters whose polls come in four parts, each poll up to 30 days late."""
    samples = written(tb.device_samples(spark, d), "samples")
    out = runs.run_in_turn(tb.in_turn(samples, late_hours=720), lambda rows: sm.counter_stream(rows, "40 days", bits=32), "counters")
    return out.select("name", "seq", r("value", 1), "unit", F.col("labels")["ifIndex"].alias("if_index"))


@query
def stream_alerts(spark, d):
    """Fires, silences and commands in four parts through the alert states, each up to 20 hours late; alerts escalate once after 30 minutes."""
    fire = tb.fires(spark, d).select("fingerprint", "ts", "seq", F.lit("fire").alias("kind"), "metric_name",
                                     "severity", "value", "score", F.lit(None).cast("double").alias("minutes"))
    told = tb.commands(spark, d).withColumnRenamed("action", "kind")
    mute = tb.silences(spark, d).select("fingerprint", F.col("start_ts").alias("ts"), F.lit(0).cast("bigint").alias("seq"),
                                        F.lit("silence").alias("kind"), F.col("minutes").cast("double").alias("minutes"))
    given = fire.unionByName(told, allowMissingColumns=True).unionByName(mute, allowMissingColumns=True)
    given = written(given, "alert-events")
    changes = runs.run_in_turn(tb.in_turn(given), lambda rows: sa.alert_stream(rows, "1 day"), "alerts")
    out = sa.latest_alerts(changes)
    return out.select("id", "fingerprint", "metric_name", "severity", "state",
                      micros(F.col("first_seen")).alias("first_us"), micros(F.col("last_seen")).alias("last_us"),
                      "count", r("value"), r("score"), "message")
