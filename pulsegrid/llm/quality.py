"""Quality by ordinal regression: a cumulative-link model on graded ratings.

One set of weights over hashed words and word shapes is shared by all grades, and ordered thresholds cut its
score: P(grade >= j) is the logistic function of score - threshold[j].  A document gets its expected
grade and the tail probability of a chosen grade, by which it can be selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import per_text
from pulsegrid.llm.features import Adam, bag, labelled
from pulsegrid.llm.texts import chunks


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above the lowest
    grades: np.ndarray  # the learned grades, ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each grade above the lowest."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def train(text: np.ndarray, bin: np.ndarray, value: np.ndarray, grade: np.ndarray, stands_for: np.ndarray, levels: int, bins: int,
          rounds: int = 120, rate: float = 0.1, decay: float = 5e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood; grades are 0 to ``levels`` - 1."""
    n = len(grade)
    part = stands_for / stands_for.sum()
    share = np.array([part[grade >= j].sum() for j in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    weights = Adam(np.zeros(bins), rate)
    # The first threshold and the logs of the gaps, so that they stay in order.
    cut = Adam(np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))]), rate / 2)
    for _ in range(rounds):
        threshold = cut.value[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut.value[1:]))])
        score = np.bincount(text, value * weights.value[bin], n)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - threshold), np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        above, below = tail[rows, grade], tail[rows, grade + 1]
        p = np.maximum(above - below, 1e-9)
        up, down = above * (1 - above), below * (1 - below)  # slopes of the two tails by the score
        by_score = -(up - down) / p * part
        by_cut = np.zeros(levels + 1)
        np.add.at(by_cut, grade, up / p * part)
        np.add.at(by_cut, grade + 1, -down / p * part)
        by_cut = by_cut[1:levels]
        weights.step(np.bincount(bin, value * by_score[text], bins) + decay * weights.value)
        after = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves all that follow
        cut.step(np.concatenate([after[:1], after[1:] * np.exp(cut.value[1:])]))
    threshold = cut.value[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut.value[1:]))])
    return weights.value.astype(np.float32), threshold


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, id: str = "doc_id", text: str = "text", use: Column | None = None,
        train_rows: int = 5000, bins: int = 1 << 18) -> Model:
    """A model from about ``train_rows`` rated documents, as many of each grade or all there are; rows that ``use`` excludes are not learned from.

    Whole-number grades that are found there make the levels.  With one grade or none nothing is learned: that grade (0 for none) is
    predicted for all.
    """
    some = labelled(docs, ratings, id, text, grade.cast("int"), F.lit(True) if use is None else use, train_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            text, bin, value = bag(batch.column("__text"), bins)
            order = np.lexsort((bin, text))
            text, bin, value = text[order], bin[order], value[order]
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("__key").cast(pa.int64()), "label": batch.column("__label"), "weight": batch.column("__weight"),
                "bin": pa.array([bin[b:e] for b, e in zip(at[:-1], at[1:])], pa.list_(pa.int32())),
                "value": pa.array([value[b:e] for b, e in zip(at[:-1], at[1:])], pa.list_(pa.float32()))})

    got = some.mapInArrow(read, "key bigint, label int, weight double, bin array<int>, value array<float>").toArrow().sort_by("key")
    label = got["label"].to_numpy() if got.num_rows else np.zeros(0, np.int64)
    grades = np.unique(label)
    if len(grades) < 2:
        return Model(np.zeros(bins, np.float32), np.zeros(0), grades if len(grades) else np.zeros(1, np.int64))
    bin, value = (got[c].combine_chunks().flatten().to_numpy() for c in ("bin", "value"))
    owner = np.repeat(np.arange(len(label)), got["bin"].combine_chunks().value_lengths().to_numpy())
    weights, thresholds = train(owner, bin, value.astype(np.float64), np.searchsorted(grades, label), got["weight"].to_numpy(),
                               len(grades), bins)
    return Model(weights, thresholds, grades)


def score(docs: DataFrame, model: Model, text: str = "text", least: int = 1) -> DataFrame:
    """All rows with expected_grade, tail (probability of grade ``least`` or more) and grade (the most likely).

    A null or empty text has no features and gets what the thresholds alone give.  Columns of these names are replaced; texts are
    scored whole.
    """
    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            owner, bin, value = bag(column, len(model.weights))
            total = np.bincount(owner, value * model.weights[bin], len(column))
            tail = np.concatenate([np.ones((len(total), 1)), model.tails(total), np.zeros((len(total), 1))], axis=1)
            each = tail[:, :-1] - tail[:, 1:]
            above = each[:, model.grades >= least].sum(1)
            return [pa.array(each @ model.grades.astype(float)), pa.array(np.clip(above, 0.0, 1.0)),
                    pa.array(model.grades[each.argmax(1)].astype(np.int32))]
        return run

    return per_text(docs, text, {"expected_grade": ("double", pa.float64()), "tail": ("double", pa.float64()),
                                 "grade": ("int", pa.int32())}, make)
