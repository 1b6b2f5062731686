"""Detectors with a trained model per series: isolation forest and autoencoder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.detectors.base import Detector, scored
from pulsegrid.operators.detectors.vectors import on_all_rows, window_vectors
from pulsegrid.operators.ordering import DEFAULT, Layout
from pulsegrid.operators.stats import guarded, join_stats, quantiles
from pulsegrid.schema import ROW_KEY, safe_div
from pulsegrid.session import shared, written

#: Vectors scored or trained on together.
BLOCK = 4096


def _expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` values."""
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One isolation tree as parallel lists; a leaf has feature -1 and its depth as cut."""
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": []}
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        at, depth, parent, side = todo.pop()
        me = len(tree["cut"])
        if parent >= 0:
            tree[side][parent] = me
        lo, hi = x[at].min(axis=0), x[at].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(at) <= 1 or not len(usable):
            for name, v in (("feature", -1), ("cut", depth + _expected_depth(len(at))), ("left", -1), ("right", -1)):
                tree[name].append(v)
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        for name, v in (("feature", f), ("cut", cut), ("left", -1), ("right", -1)):
            tree[name].append(v)
        below = x[at, f] < cut
        todo.append((at[below], depth + 1, me, "left"))
        todo.append((at[~below], depth + 1, me, "right"))
    return tree


def _depths(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype="int64")
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return cut[at]
        rows, node = np.flatnonzero(inner), at[inner]
        below = x[rows, feature[node]] < cut[node]
        at[rows] = np.where(below, left[node], right[node])


class IsolationForest(Detector):
    """How few random cuts separate a window from the others.

    Every tree is grown from its own sample of the series, picked by hash, so the
    groups stay small however long the series is.  Scoring meets the trees of a
    series once per block of windows.
    """

    name = "isolation_forest"

    def __init__(self, contamination: float = 0.05, trees: int = 100, window: int = 10, sample: int = 256,
                 seed: int = 42, layout: Layout = DEFAULT):
        self.contamination, self.trees, self.window = contamination, trees, window
        self.sample, self.seed, self.layout = sample, seed, layout

    def grow(self, vectors: DataFrame) -> DataFrame:
        """``(series_id, tree, sampled, feature, cut, left, right)``."""
        seed, psi = self.seed, self.sample
        n = vectors.groupBy("series_id").agg(F.count("*").alias("_n"))
        trees = F.sequence(F.lit(0), F.lit(self.trees - 1))
        # each window joins a tree with chance sample / n
        share = F.lit(psi) / F.col("_n")
        mine = F.filter(trees, lambda t: F.pmod(F.xxhash64("idx", t, F.lit(seed)), F.lit(2 ** 53)) < share * 2.0 ** 53)
        picked = join_stats(vectors, n).select("series_id", "idx", "vec", F.explode(mine).alias("tree"))
        limit = max(1, math.ceil(math.log2(psi)))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            sid, tree = pdf["series_id"].iloc[0], int(pdf["tree"].iloc[0])
            grown = _grow(np.stack(pdf["vec"].to_numpy()), np.random.default_rng([seed, tree]), limit)
            return pd.DataFrame([{"series_id": sid, "tree": tree, "sampled": len(pdf), **grown}])

        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return picked.repartition(parts, "series_id", "tree").groupBy("series_id", "tree").applyInPandas(
            one, "series_id string, tree int, sampled int, feature array<int>, cut array<double>, "
                 "left array<int>, right array<int>")

    def isolation(self, vectors: DataFrame, forest: DataFrame) -> DataFrame:
        """``(series_id, idx, score)`` in 0..1, near 1 for windows that are cut off early."""
        blocks = vectors.select("series_id", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "vec")
        copies = blocks.select("series_id", "block").distinct().join(forest, "series_id")
        copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def score(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or trees.empty:
                return pd.DataFrame({"series_id": pd.Series(dtype=object), "idx": pd.Series(dtype="int64"),
                                     "score": pd.Series(dtype="float64")})
            x = np.stack(rows["vec"].to_numpy())
            depth = np.zeros(len(x))
            for t in trees.sort_values("tree").itertuples():
                depth += _depths(x, *(np.asarray(a) for a in (t.feature, t.cut, t.left, t.right)))
            usual = _expected_depth(float(trees["sampled"].mean())) or 1.0
            return pd.DataFrame({"series_id": key[0], "idx": rows["idx"].to_numpy(),
                                 "score": 2.0 ** (-(depth / len(trees)) / usual)})

        on = ["series_id", "block"]
        return (blocks.repartition(parts, *on).groupBy(*on).cogroup(copies.repartition(parts, *on).groupBy(*on))
                .applyInPandas(score, "series_id string, idx bigint, score double"))

    def fit(self, rows: DataFrame) -> DataFrame:
        return self._fit(written(window_vectors(rows, self.window, self.layout), "vectors"))[0]

    def _fit(self, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        forest = written(self.grow(vectors), "forest")
        found = written(self.isolation(vectors, forest), "isolation")
        limit = quantiles(found, {"threshold": 1 - self.contamination}, "score").drop("n")
        return join_stats(forest, limit), found

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        vectors = written(window_vectors(rows, self.window, self.layout), "vectors")
        if params is None:
            params, found = self._fit(vectors)
        else:
            found = self.isolation(vectors, params.drop("threshold"))
        limit = params.groupBy("series_id").agg(F.first("threshold").alias("threshold"))
        found = vectors.join(join_stats(found, limit), ["series_id", "idx"])
        found = found.select(*ROW_KEY, "score", (F.col("score") > F.col("threshold")).alias("_flag"))
        whole = rows.select(*ROW_KEY, "value").join(found, ROW_KEY, "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0)))
        span = whole.groupBy("series_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        scaled = safe_div(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return scored(join_stats(whole, span), self.name, F.coalesce(scaled, F.col("score")), F.col("_flag"))

    def fit_detect(self, rows: DataFrame) -> DataFrame:
        return self.detect(rows)


# --- autoencoder -------------------------------------------------------------

def _unpack(w: np.ndarray, d: int, h: int) -> tuple[np.ndarray, ...]:
    cut = np.cumsum([d * h, h, h * d])
    w1, b1, w2, b2 = np.split(np.asarray(w, dtype=float), cut)
    return w1.reshape(d, h), b1, w2.reshape(h, d), b2


def _start_weights(d: int, h: int, seed: int) -> list[float]:
    """Random normal weights scaled by fan-in, biases 0."""
    rng = np.random.RandomState(seed)
    first = rng.randn(d, h) * math.sqrt(2.0 / d)
    second = rng.randn(h, d) * math.sqrt(2.0 / h)
    return np.concatenate([first.ravel(), np.zeros(h), second.ravel(), np.zeros(d)]).tolist()


def _forward(x: np.ndarray, w: np.ndarray, d: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = _unpack(w, d, h)
    hidden = np.maximum(x @ w1 + b1, 0.0)
    return hidden, hidden @ w2 + b2


class Autoencoder(Detector):
    """Reconstruction error of a small network trained on the windows of the series.

    One hidden layer, trained by full-batch gradient descent.  A gradient is a sum
    over windows: each epoch sums the contributions of blocks of windows per
    series and steps the weights, which are rows of a table too.
    """

    name = "autoencoder"
    def __init__(self, hidden: int = 5, window: int = 10, epochs: int = 50, learning_rate: float = 0.01,
                 percentile: float = 95.0, seed: int = 42, layout: Layout = DEFAULT):
        self.hidden, self.window, self.epochs, self.learning_rate = hidden, window, epochs, learning_rate
        self.percentile, self.seed, self.layout = percentile, seed, layout

    def _blocks(self, vectors: DataFrame, scale: DataFrame) -> DataFrame:
        """Standardised windows, ``BLOCK`` to a row."""
        d = self.window
        z = F.array(*[(F.col("vec")[j] - F.col("mean")[j]) / F.col("sd")[j] for j in range(d)])
        return (join_stats(vectors, scale)
                .groupBy("series_id", F.floor(F.col("idx") / BLOCK).alias("block"))
                .agg(F.sort_array(F.collect_list(F.struct("idx", z.alias("z")))).alias("rows"))
                .select("series_id", "block", F.col("rows.idx").alias("idx"), F.flatten("rows.z").alias("x")))

    def _scale(self, vectors: DataFrame) -> DataFrame:
        d = self.window
        got = vectors.groupBy("series_id").agg(
            F.count("*").alias("n"), *[F.avg(F.col("vec")[j]).alias(f"m{j}") for j in range(d)],
            *[guarded(F.stddev_pop(F.col("vec")[j])).alias(f"s{j}") for j in range(d)])
        return got.select("series_id", "n", F.array(*[f"m{j}" for j in range(d)]).alias("mean"),
                          F.array(*[f"s{j}" for j in range(d)]).alias("sd"))

    def train(self, blocks: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Weights per series after the last epoch, and before its update.

        One job per epoch: the weights, a written table of known size, join the
        blocks in place; every task adds up what its blocks contribute per series,
        so only one gradient per task and series is shuffled.
        """
        d, h, rate = self.window, self.hidden, self.learning_rate
        start = F.array(*[F.lit(w) for w in _start_weights(d, h, self.seed)])
        weights = written(counts.select("series_id", "n", start.alias("w")), "weights")

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, list] = {}
            for batch in batches:
                for sid, n, ws, xs in batch.itertuples(index=False):
                    z = np.asarray(xs).reshape(-1, d)
                    hidden, back = _forward(z, ws, d, h)
                    error = back - z
                    inner = (error @ _unpack(ws, d, h)[2].T) * (hidden > 0)
                    g = np.concatenate([(z.T @ inner).ravel(), inner.sum(0), (hidden.T @ error).ravel(), error.sum(0)])
                    if sid in sums:
                        sums[sid][2] += g
                    else:
                        sums[sid] = [n, ws, g]
            yield pd.DataFrame([(sid, n, ws, g) for sid, (n, ws, g) in sums.items()],
                               columns=["series_id", "n", "w", "g"])

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            n, w = pdf["n"].iloc[0], np.asarray(pdf["w"].iloc[0])
            g = np.sum(np.stack(pdf.sort_values("g", key=lambda c: c.map(lambda a: a[0]))["g"].to_numpy()), axis=0)
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "n": [n], "w": [w - rate * g / n]})

        before = weights
        for _ in range(self.epochs):
            before = weights
            given = join_stats(blocks, weights, how="inner").select("series_id", "n", "w", "x")
            sums = given.mapInPandas(partial, "series_id string, n bigint, w array<double>, g array<double>")
            weights = written(sums.groupBy("series_id").applyInPandas(
                step, "series_id string, n bigint, w array<double>"), "weights")
        return weights.select("series_id", "w"), before.select("series_id", "w")

    def _errors(self, blocks: DataFrame, weights: DataFrame) -> DataFrame:
        d, h = self.window, self.hidden

        @F.pandas_udf("array<double>")
        def error(x: pd.Series, w: pd.Series) -> pd.Series:
            out = []
            for xs, ws in zip(x, w):
                z = np.asarray(xs).reshape(-1, d)
                out.append(((_forward(z, ws, d, h)[1] - z) ** 2).mean(axis=1))
            return pd.Series(out)

        each = join_stats(blocks, weights, how="inner").select("series_id", F.explode(
            F.arrays_zip("idx", error("x", "w").alias("error"))).alias("e"))
        return each.select("series_id", F.col("e.idx").alias("idx"), F.col("e.error").alias("error"))

    def fit(self, rows: DataFrame) -> DataFrame:
        """``(series_id, mean, sd, w, threshold)``."""
        return self._fit(written(window_vectors(rows, self.window, self.layout), "vectors"))

    def _fit(self, vectors: DataFrame) -> DataFrame:
        scale = written(self._scale(vectors), "scale")
        blocks = written(self._blocks(vectors, scale), "blocks")
        weights, before = self.train(blocks, scale.select("series_id", "n"))
        # the threshold is set on the outputs of the last epoch, before its update
        limit = quantiles(self._errors(blocks, before), {"threshold": self.percentile / 100}, "error").drop("n")
        fitted = scale.drop("n").join(weights, "series_id").join(limit, "series_id")
        return written(fitted, "autoencoder")

    def detect(self, rows: DataFrame, params: DataFrame | None = None) -> DataFrame:
        vectors = written(window_vectors(rows, self.window, self.layout), "vectors")
        if params is None:
            params = self._fit(vectors)
        blocks = self._blocks(vectors, params.select("series_id", "mean", "sd"))
        errors = self._errors(blocks, params.select("series_id", "w"))
        found = vectors.join(errors, ["series_id", "idx"])
        found = shared(join_stats(found, params.select("series_id", "threshold")), "errors")
        return on_all_rows(rows, found, self.name, F.col("error"), F.col("error") > F.col("threshold"))

    def fit_detect(self, rows: DataFrame) -> DataFrame:
        return self.detect(rows)
