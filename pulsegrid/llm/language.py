"""Language of texts by a byte convolutional network: filters of several widths, max pooling, softmax.

The network is trained in NumPy on the driver, on a bounded sample of labelled texts, and applied to
windows of a fixed number of bytes, all windows of a text.  A text's probabilities are the normalised geometric mean of
those of its windows, each weighing as its bytes.  For use, the filters are turned into tables over pairs of
bytes, so that a filter is a sum of one or two lookups at each place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import per_text
from pulsegrid.llm.features import Adam
from pulsegrid.llm.texts import _LOWER, buffer

WIDTHS = (2, 3, 4)


def windows(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with spaces, the text and the number of own bytes of each; A-Z count as a-z."""
    length = np.diff(at)
    count = -(-length // size)
    owner = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[owner] + k * size
    own = np.minimum(size, at[owner + 1] - begin)
    out = np.full((len(owner), size), 0x20, np.uint8)
    inside = np.arange(size)[None, :] < own[:, None]
    out[inside] = _LOWER[data]
    return out, owner, own


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x dimensions
    filters: dict[int, np.ndarray]  # of each width: width x dimensions x filters
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Of each width, the responses to pairs of bytes, and to the byte after them where the width is odd."""
        out = {}
        for w, f in self.filters.items():
            single = [(self.embedding @ f[j]).astype(np.float32) for j in range(w)]
            parts = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            out[w] = parts + ([single[w - 1]] if w % 2 else [])
        return out

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], at_once: int = 256) -> np.ndarray:
        """Log-probabilities of the languages for each window."""
        out = np.empty((len(x), len(self.languages)), np.float64)
        for b in range(0, len(x), at_once):
            part = x[b:b + at_once]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, parts in tables.items():
                n = part.shape[1] - w + 1
                total = parts[0][pair[:, :n]]
                for j, t in enumerate(parts[1:], 1):
                    total += t[pair[:, 2 * j:2 * j + n]] if len(t) > 256 else t[part[:, 2 * j:2 * j + n]]
                pooled.append(np.maximum(total.max(1) + self.bias[w], 0))
            z = np.concatenate(pooled, axis=1) @ self.weights + self.offset
            z -= z.max(1, keepdims=True)
            out[b:b + at_once] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], dimensions: int = 8, filters: int = 12, epochs: int = 6,
          batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit the network to windows ``x`` (bytes) and their languages ``y`` by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    net = Network(languages, rng.normal(0, 0.5, (256, dimensions)),
                  {w: rng.normal(0, 1 / np.sqrt(w * dimensions), (w, dimensions, filters)) for w in WIDTHS},
                  {w: np.zeros(filters) for w in WIDTHS}, rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))), np.zeros(len(languages)))
    steps = {"e": Adam(net.embedding, rate), "o": Adam(net.weights, rate), "c": Adam(net.offset, rate),
             **{("f", w): Adam(net.filters[w], rate) for w in WIDTHS}, **{("b", w): Adam(net.bias[w], rate) for w in WIDTHS}}
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for b in range(0, len(x), batch):
            at = order[b:b + batch]
            part, target = x[at], y[at]
            n = len(at)
            embedded = net.embedding[part]
            pooled, places = [], []
            for w in WIDTHS:
                m = part.shape[1] - w + 1
                total = sum(embedded[:, j:j + m] @ net.filters[w][j] for j in range(w)) + net.bias[w]
                place = total.argmax(1)
                places.append(place)
                pooled.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            z = h @ net.weights + net.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), target] -= 1
            p /= n
            back = (p @ net.weights.T) * (h > 0)
            by_embedding = np.zeros_like(net.embedding)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * filters:(i + 1) * filters]
                by_filter = np.zeros_like(net.filters[w])
                for j in range(w):
                    byte = np.take_along_axis(part, places[i] + j, 1)  # n x filters
                    by_filter[j] = np.einsum("nfd,nf->df", net.embedding[byte], g)
                    np.add.at(by_embedding, byte.ravel(), (g[:, :, None] * net.filters[w][j].T[None]).reshape(-1, by_embedding.shape[1]))
                steps["f", w].step(by_filter)
                steps["b", w].step(g.sum(0))
            steps["o"].step(h.T @ p)
            steps["c"].step(p.sum(0))
            steps["e"].step(by_embedding)
    return net


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", use: Column | None = None,
        train_rows: int = 3000, size: int = 256, each: int = 2) -> Network | None:
    """A network from about ``train_rows`` texts with a language, up to ``each`` windows of each text, chosen by a hash.

    Every language of the rows that ``use`` allows is learned, from about as many texts each.  None without any.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0) & (F.lit(True) if use is None else use))
    counts = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    bits = 1 << 30
    share = F.coalesce(*[F.when(F.col(lang) == name, F.lit(int(bits * min(1.0, train_rows / len(languages) / n))))
                         for name, n in counts.items()])
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    some = known.where(F.pmod(F.xxhash64(key, F.lit(13)), F.lit(bits)) < share).select(
        F.xxhash64(key, F.lit(17)).alias("h"), F.col(lang).alias("lang"),
        F.substring(F.col(text), F.pmod(F.xxhash64(key), F.greatest(F.length(text) - size * each, F.lit(1))).cast("int") + 1,
                    F.lit(size * each)).alias("text")).limit(4 * train_rows).toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    if not some.num_rows:
        some = known.select(F.col(lang).alias("lang"), F.substring(F.col(text), 1, size * each).alias("text")).limit(train_rows).toArrow()
    data, at = buffer(some["text"])
    x, owner, own = windows(data, at, size)
    full = own >= 16 if (own >= 16).any() else own > 0
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[name] for name in some["lang"].to_pylist()])[owner]
    return train(x[full], y[full], languages)


def predict(docs: DataFrame, net: Network | None, text: str = "text", size: int = 256) -> DataFrame:
    """All rows with lang_pred and score, the probability of that language.

    A null text, or one without a letter, is ``und`` with score 0, as is every text without a network.  Columns of these names are
    replaced; texts are read whole.
    """
    def make():
        tables = net.tables() if net else {}

        def run(column: pa.Array) -> list[pa.Array]:
            n = len(column)
            if net is None:
                return [pa.array(["und"] * n), pa.array(np.zeros(n))]
            data, at = buffer(column)
            x, owner, own = windows(data, at, size)
            logs = net.probabilities(x, tables) * own[:, None]
            total = np.stack([np.bincount(owner, logs[:, c], n) for c in range(len(net.languages))], axis=1)
            total = total / np.maximum(np.diff(at), 1)[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            return [pa.array([net.languages[b] for b in best]), pa.array(p[np.arange(n), best])]
        return run

    found = per_text(docs, text, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())}, make)
    letters = F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False))
    return found.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(F.lit("und"))).withColumn(
        "score", F.when(letters, F.col("score")).otherwise(F.lit(0.0)))
