"""Moving averages, dominant periods and seasonal decomposition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.ordering import DEFAULT, Layout, framed, with_index, with_running
from pulsegrid.operators.stats import join_stats
from pulsegrid.schema import safe_div
from pulsegrid.session import shared, written

#: Values that one task transforms at a time when lagged products are searched.
FFT_BAND = 1 << 20
#: Lagged products that differ by less than this share of a series' energy count as equal.
LAG_SLACK = 1e-12


def moving_average(rows: DataFrame, window: int, name: str = "trend",
                   layout: Layout = DEFAULT) -> DataFrame:
    """Centred mean over ``window // 2`` rows on both sides, shorter at the ends, skipping NULLs."""
    rows = with_index(rows, layout)
    if window <= 1:
        return rows.withColumn(name, F.col("value"))
    half = window // 2
    return framed(rows, half, half, lambda w: {name: F.avg("value").over(w.rowsBetween(-half, half))},
                  layout)


def _moving_average_each(rows: DataFrame, layout: Layout) -> DataFrame:
    """Same with a window per series (column ``period``).

    A frame cannot vary by row, so each row sends its running total to the two
    positions whose frame ends there.  Totals are of deviations from the series
    mean, which keeps them small.
    """
    stats = rows.groupBy("series_id").agg(F.count("*").alias("_n"), F.avg("value").alias("_m"),
                                          F.count("value").alias("_call"))
    rows = join_stats(rows, stats)
    off = F.coalesce(F.col("value") - F.col("_m"), F.lit(0.0))
    rows = with_running(rows, {"_ps": off, "_pc": F.col("value").isNotNull().cast("bigint")}, layout)
    half = F.floor(F.col("period") / 2).cast("bigint")
    idx = F.col("idx")
    data = [c for c in rows.columns if c not in ("series_id", "_ps", "_pc")]
    sent = (rows.select("series_id", F.struct(*data).alias("row"),
                        F.struct("_ps", "_pc").alias("total"), (F.col("_n") - 1).alias("end"),
                        F.posexplode(F.array(idx, idx - half, idx + half + 1)).alias("kind", "at"))
            .filter("at between 0 and end"))
    kind = F.col("kind")
    met = sent.groupBy("series_id", "at").agg(
        F.first(F.when(kind == 0, F.col("row")), ignorenulls=True).alias("row"),
        F.first(F.when(kind == 1, F.col("total")), ignorenulls=True).alias("hi"),
        F.first(F.when(kind == 2, F.col("total")), ignorenulls=True).alias("lo"))
    # beyond the last row the running total is the series total: 0 in deviations
    s = F.coalesce(F.col("hi._ps"), F.lit(0.0)) - F.coalesce(F.col("lo._ps"), F.lit(0.0))
    c = F.coalesce(F.col("hi._pc"), F.col("row._call")) - F.coalesce(F.col("lo._pc"), F.lit(0))
    return (met.select("series_id", "row.*", (F.col("row._m") + safe_div(s, c)).alias("trend"))
            .drop("_n", "_m", "_call"))


def _local_best(lags: np.ndarray, dots: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The lags that can be the first to come within ``slack`` of the highest product, whatever other tasks hold.

    ``lags`` ascend.  Such a lag exceeds all before it, so a flat stretch sends one lag only.
    """
    if not len(lags):
        return lags, dots
    if np.isnan(dots).any():  # an infinite value: no lag is better than the first
        return lags[:1], np.array([np.inf])
    before = np.concatenate([[-np.inf], np.maximum.accumulate(dots)[:-1]])
    keep = (dots > before) & (dots >= dots.max() - slack)
    return lags[keep], dots[keep]


def _best_table(lags: np.ndarray, dots: np.ndarray, sid: str, slack: float) -> pd.DataFrame:
    lags, dots = _local_best(lags, dots, slack)
    return pd.DataFrame({"series_id": sid, "lag": lags, "dot": dots})


def _lags_at_once(lo: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Lagged products of a series that fits one band."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sid, bits, longest, slack = key
        x = np.zeros(1 << bits)
        x[rows["idx"].to_numpy()] = rows["c"].to_numpy()
        spectrum = np.fft.rfft(x)
        dots = np.fft.irfft(spectrum.real ** 2 + spectrum.imag ** 2, len(x))[lo:longest + 1]
        return _best_table(np.arange(lo, longest + 1), dots, sid, slack)
    return run


@dataclass(frozen=True)
class _Grid:
    """A transform of ``2**bits`` places as a matrix: place ``row * cols + col``, cut into bands of whole columns or rows."""

    bits: int
    band: int

    @property
    def rows(self) -> int:
        return 1 << self.bits // 2

    @property
    def cols(self) -> int:
        return 1 << self.bits - self.bits // 2

    @property
    def wide(self) -> int:
        """Columns per band."""
        return max(1, min(self.cols, self.band // self.rows))

    @property
    def high(self) -> int:
        """Rows per band."""
        return max(1, min(self.rows, self.band // self.cols))

    def turn(self, row: np.ndarray, col: np.ndarray, sign: int) -> np.ndarray:
        angle = (2 * np.pi / (1 << self.bits)) * (row[:, None] * col[None, :])
        return np.exp(sign * 1j * angle)


def _blocks(sid: str, bits: int, longest: int, slack: float, source: int, parts: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"series_id": sid, "bits": bits, "longest": longest, "slack": slack, "band": range(len(parts)),
                         "source": source, "data": [np.ascontiguousarray(p).tobytes() for p in parts]})


def _columns_out(band: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A band of columns, each transformed along the rows; sent on by bands of rows."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sid, bits, longest, slack, at = key
        g = _Grid(bits, band)
        idx, first = rows["idx"].to_numpy(), at * g.wide
        m = np.zeros((g.rows, g.wide))
        m[idx // g.cols, idx % g.cols - first] = rows["c"].to_numpy()
        out = np.fft.fft(m, axis=0) * g.turn(np.arange(g.rows), first + np.arange(g.wide), -1)
        return _blocks(sid, bits, longest, slack, at, [out[i:i + g.high] for i in range(0, g.rows, g.high)])
    return run


def _rows_there_and_back(band: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A band of rows: the rest of the transform, its power, and the first half of the way back; sent by bands of columns."""
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        sid, bits, longest, slack, at = key
        g = _Grid(bits, band)
        m = np.zeros((g.high, g.cols), dtype=complex)
        for source, data in zip(parts["source"], parts["data"]):
            m[:, source * g.wide:(source + 1) * g.wide] = np.frombuffer(data, complex).reshape(g.high, g.wide)
        spectrum = np.fft.fft(m, axis=1)
        back = np.fft.ifft(spectrum.real ** 2 + spectrum.imag ** 2, axis=1)
        back *= g.turn(at * g.high + np.arange(g.high), np.arange(g.cols), 1)
        return _blocks(sid, bits, longest, slack, at, [back[:, i:i + g.wide] for i in range(0, g.cols, g.wide)])
    return run


def _columns_back(band: int, lo: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A band of columns of lags: the products, and the lags that can be best."""
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        sid, bits, longest, slack, at = key
        g = _Grid(bits, band)
        m = np.zeros((g.rows, g.wide), dtype=complex)
        for source, data in zip(parts["source"], parts["data"]):
            m[source * g.high:(source + 1) * g.high] = np.frombuffer(data, complex).reshape(g.high, g.wide)
        dots = np.fft.ifft(m, axis=0).real
        lags = np.arange(g.rows)[:, None] * g.cols + (at * g.wide + np.arange(g.wide))[None, :]
        use = (lags >= lo) & (lags <= longest)  # row by row, so lags ascend
        return _best_table(lags[use], dots[use], sid, slack)
    return run


def _lag_products(rows: DataFrame, lo: int, band: int, split: bool) -> DataFrame:
    """Candidates ``(series_id, lag, dot)`` from rows ``(series_id, idx, c, bits, longest, slack)``.

    The products of all lags are the transform of the power of a series padded with zeros.  A series of more than
    ``band`` places is transformed as a matrix, by columns and then by rows, and back by columns: three shuffles of the
    series, whatever its length, in pieces of ``band`` places.
    """
    best, block = "series_id string, lag bigint, dot double", (
        "series_id string, bits int, longest bigint, slack double, band bigint, source bigint, data binary")
    keys = ["series_id", "bits", "longest", "slack"]
    fits = F.pow(F.lit(2.0), "bits") <= band
    whole = rows.filter(fits).groupBy(*keys).applyInPandas(_lags_at_once(lo), best)
    if not split:
        return whole
    tall = F.floor(F.col("bits") / 2)
    cols, high = F.pow(F.lit(2.0), F.col("bits") - tall), F.pow(F.lit(2.0), tall)
    wide = F.greatest(F.lit(1.0), F.least(cols, F.floor(F.lit(band) / high))).cast("bigint")
    at = F.floor((F.col("idx") % cols.cast("bigint")) / wide).cast("bigint")
    out = (rows.filter(~fits).withColumn("band", at).groupBy(*keys, "band").applyInPandas(_columns_out(band), block)
           .groupBy(*keys, "band").applyInPandas(_rows_there_and_back(band), block)
           .groupBy(*keys, "band").applyInPandas(_columns_back(band, lo), best))
    return whole.unionByName(out)


def estimate_period(rows: DataFrame, min_period: int = 2, max_period: int | None = None,
                    layout: Layout = DEFAULT, band: int = FFT_BAND) -> DataFrame:
    """Lag with the highest autocorrelation per series, as ``period``.

    Searches ``min_period`` .. ``max_period`` (default a third of the series, at most half), the shortest lag among those
    whose products differ by less than ``LAG_SLACK`` of the series' energy.  The search is a Fourier transform, cut into
    pieces of ``band`` values for a series that is longer, so its cost grows with the length of a series and not with the
    number of lags.  NULL values count as the mean; a series with an infinite value, without variation or of fewer than
    two periods has ``min_period``.
    """
    rows = shared(with_index(rows, layout).select("series_id", "idx", "value"), "indexed")
    stats = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"),
                                          (F.var_pop("value") * F.count("value")).alias("energy"))
    n = F.col("n")
    longest = F.lit(max_period) if max_period is not None else F.greatest(
        F.lit(min_period + 1), F.floor(n / 3))
    longest = F.least(longest, F.floor(n / 2)).cast("bigint")
    # places enough that no lag up to the longest wraps round
    stats = written(stats.withColumns({
        "longest": longest, "bits": F.ceil(F.log2((n + longest).cast("double"))).cast("int"),
        "slack": F.col("energy") * LAG_SLACK}), "period-stats")
    usable = (n >= 2 * min_period) & (F.col("energy") > 0)
    searched = stats.filter(usable & (F.col("longest") >= min_period))
    bits = searched.agg(F.max("bits")).first()[0] or 0
    centred = F.coalesce(F.col("value") - F.col("mean"), F.lit(0.0))
    centred = join_stats(rows, searched.select("series_id", "mean", "longest", "bits", "slack"), how="inner").select(
        "series_id", "idx", centred.alias("c"), "bits", "longest", "slack")
    found = written(_lag_products(centred, min_period, band, 1 << bits > band), "lags")
    top = found.groupBy("series_id").agg(F.max("dot").alias("top"))
    best = (found.join(top, "series_id").join(stats.select("series_id", "slack"), "series_id")
            .filter(F.col("dot") >= F.col("top") - F.col("slack")).groupBy("series_id").agg(F.min("lag").alias("best")))
    period = F.coalesce(F.when(usable, F.col("best")), F.lit(min_period)).cast("bigint")
    # one row per series that everything downstream depends on: computed once
    return written(stats.join(best, "series_id", "left").select("series_id", period.alias("period")), "period")


def with_trend(rows: DataFrame, period: int | DataFrame | None = None,
               layout: Layout = DEFAULT) -> DataFrame:
    """Add ``idx``, ``period`` (at least 2), ``phase`` and ``trend``."""
    rows = with_index(rows, layout)
    if isinstance(period, int):
        period = max(2, period)
        rows = moving_average(rows, period, layout=layout).withColumn("period", F.lit(period).cast("bigint"))
    else:
        if period is None:
            period = estimate_period(rows, layout=layout)
        period = period.select("series_id", F.greatest(F.lit(2), F.col("period")).alias("period"))
        rows = _moving_average_each(join_stats(rows, period, how="inner"), layout)
    return rows.withColumn("phase", F.col("idx") % F.col("period"))


def phase_table(trended: DataFrame, model: str = "additive") -> DataFrame:
    """Seasonal value per series and phase, levelled to mean 0 (additive) or 1 (multiplicative)."""
    v, t = F.col("value"), F.col("trend")
    detrended = safe_div(v, t) if model == "multiplicative" else v - t
    phases = trended.groupBy("series_id", "phase").agg(
        F.coalesce(F.avg(detrended), F.lit(0.0)).alias("raw"))
    level = phases.groupBy("series_id").agg(F.avg("raw").alias("level"))
    return phases.join(level, "series_id").select(
        "series_id", "phase", _levelled(F.col("raw"), F.col("level"), model).alias("seasonal"))


def _levelled(raw: Column, level: Column, model: str) -> Column:
    if model == "multiplicative":
        return F.when(level == 0, raw).otherwise(safe_div(raw, level))
    return raw - level


def seasonal_decompose(rows: DataFrame, period: int | DataFrame | None = None,
                       model: str = "additive", layout: Layout = DEFAULT) -> DataFrame:
    """Add ``idx, period, phase, trend, seasonal, residual``.

    ``period`` is a number of rows, a table ``(series_id, period)``, or None to
    estimate it.
    """
    trended = shared(with_trend(rows, period, layout), "trended")
    out = join_stats(trended, phase_table(trended, model), ["series_id", "phase"])
    v, t, s = F.col("value"), F.col("trend"), F.col("seasonal")
    return out.withColumn("residual", safe_div(v, t * s) if model == "multiplicative" else v - t - s)
