"""Toxicity by multiple-instance learning: sentences are scored, a document is their noisy-or.

Only documents are labelled.  A sentence's probability is a logistic function of weights of its words and
their stems, and a document is toxic with 1 minus the product of the sentences' complements; the
likelihood of the documents' labels trains the weights, and the sentences' own scores tell where a document offends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import per_text
from pulsegrid.llm.features import Adam, labelled, sentence_words
from pulsegrid.llm.hashtable import HashTable
from pulsegrid.llm.texts import chunks
from pulsegrid.session import discard, written


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Log-odds of a sentence: ``bias`` and the weights of its words and stems, 0 for one that was not learned."""

    keys: np.ndarray
    weights: np.ndarray  # one more than keys: the last is 0
    bias: float

    def scorer(self) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        table = HashTable(max(8, len(self.keys)))
        table.add(self.keys)

        def sentences(words: dict[str, np.ndarray]) -> np.ndarray:
            return self.bias + np.bincount(words["sentence"], self.weights[table.find(words["term"])], len(words["owner"]))
        return sentences


def train(term: np.ndarray, sentence: np.ndarray, owner: np.ndarray, keys: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray,
          rounds: int = 150, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Fit the noisy-or of sentences to the labels of the texts by full gradient steps.

    ``term`` holds positions in ``keys`` and ``sentence`` the sentence of each; ``owner`` is the text of each sentence.
    """
    docs, n = len(toxic), len(keys)
    weights, bias = Adam(np.zeros(n), rate), Adam(np.array([-6.0]), rate)
    part = stands_for / stands_for.sum()
    for _ in range(rounds):
        p = _sigmoid(bias.value[0] + np.bincount(sentence, weights.value[term], len(owner)))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), docs))
        odds = np.where(toxic, clean / np.maximum(1 - clean, 1e-9), -1.0) * part
        slope = -p * odds[owner]  # of the loss by each sentence's log-odds
        weights.step(np.bincount(term, slope[sentence], n) + decay * weights.value)
        bias.step(np.array([slope.sum()]))
    return Model(keys, np.append(weights.value, 0).astype(np.float32), float(bias.value[0]))


def _learned(rows: DataFrame) -> np.ndarray:
    """Terms of at least 3 texts and one text in 500, ascending: at most a few hundred for each sampled text."""
    least = max(3, rows.count() // 500)
    seen = rows.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count().where(F.col("count") >= least)
    return np.sort(seen.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        use: Column | None = None, train_rows: int = 3000) -> Model:
    """A model from about ``train_rows`` labelled documents, half of each label or all there are; rows that ``use`` excludes are not learned from.

    Terms of fewer texts than 3, or than one in 500, are not learned; the tasks drop them, so that only the others reach the driver.
    Without a toxic and a clean document nothing is learned, and every text scores near 0.
    """
    some = labelled(docs, labels, id, text, F.col(label).cast("int"), F.lit(True) if use is None else use, train_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            found = sentence_words(batch.column("__text"))
            sentences = np.bincount(found["owner"], minlength=batch.num_rows)
            text_of = found["owner"][found["sentence"]]
            inner = found["sentence"] - (np.cumsum(sentences) - sentences)[text_of]
            at = np.searchsorted(text_of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("__key").cast(pa.int64()), "label": batch.column("__label"), "weight": batch.column("__weight"),
                "sentences": pa.array(sentences, pa.int64()), "term": pa.ListArray.from_arrays(at, found["term"].view(np.int64)),
                "sentence": pa.ListArray.from_arrays(at, inner.astype(np.int32))})

    schema = "key bigint, label int, weight double, sentences bigint, term array<bigint>, sentence array<int>"
    rows = written(some.mapInArrow(read, schema), "sentences")
    keys = _learned(rows)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(max(8, len(keys)))
        table.add(keys)
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column("term").value_lengths().to_numpy())])
            place = table.find(batch.column("term").flatten().to_numpy().view(np.uint64))
            keep = place >= 0
            to = np.concatenate([[0], np.cumsum(keep)])[at].astype(np.int32)
            inner = batch.column("sentence").flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("key", "label", "weight", "sentences")},
                "term": pa.ListArray.from_arrays(to, place[keep]), "sentence": pa.ListArray.from_arrays(to, inner[keep])})

    got = rows.orderBy("key").mapInArrow(known, schema.replace("term array<bigint>", "term array<int>")).toArrow()
    discard(rows)
    toxic = got["label"].to_numpy().astype(bool) if got.num_rows else np.zeros(0, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.uint64), np.zeros(1, np.float32), -20.0)
    weight, sentences = got["weight"].to_numpy(), got["sentences"].to_numpy()
    size = np.concatenate([c.value_lengths().to_numpy() for c in got["term"].chunks])
    term = np.concatenate([c.flatten().to_numpy() for c in got["term"].chunks]).astype(np.int64)
    sentence = np.concatenate([c.flatten().to_numpy() for c in got["sentence"].chunks]) + np.repeat(np.cumsum(sentences) - sentences, size)
    del got
    return train(term, sentence, np.repeat(np.arange(len(toxic)), sentences), keys, toxic, weight)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows with score (0 to 1), predicted (1 from ``threshold`` on) and offending: byte spans of the sentences that alone reach it.

    A null or empty text, or one without words, has no sentences and scores 0.  Columns of these names are replaced; any text length is
    scored whole.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        sentences = model.scorer()

        def run(column: pa.Array) -> list[pa.Array]:
            words = sentence_words(column)
            p = _sigmoid(sentences(words))
            owner, n = words["owner"], len(column)
            total = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
            total = np.clip(total, 0.0, 1.0)
            hit = np.flatnonzero(p >= threshold)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for i in hit:
                spans[owner[i]].append({"start": int(words["start"][i]), "end": int(words["end"][i]), "score": float(p[i])})
            return [pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.array(spans, span)]
        return run

    return per_text(docs, text, {
        "score": ("double", pa.float64()), "predicted": ("int", pa.int32()),
        "offending": ("array<struct<start:bigint,end:bigint,score:double>>", span)}, make)
