"""Hashed text features of Arrow columns, and bounded labelled samples to train on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.texts import buffer, mix, span_hashes, words

_INSIDE = np.zeros(256, bool)
_INSIDE[0x41:0x5B] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x61:0x7B] = _KIND[0x80:] = ord("a")
_KIND[0x41:0x5B] = ord("A")
_KIND[0x30:0x3A] = ord("0")
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true bytes, cut at the borders of texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[at] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]


def sentence_words(column: pa.Array, stems: tuple[int, ...] = (4, 5)) -> dict[str, np.ndarray]:
    """Words of letters and their stems, once for each sentence.

    ``term`` is a hash of a word or of its first bytes, as many as ``stems`` says; ``sentence`` is the
    number of its sentence, of which ``owner``, ``start`` and ``end`` give the text and the bytes in it.
    Sentences end after . ! ? or a line feed and hold at least one word; A-Z count as a-z.
    """
    data, at = buffer(column)
    starts, ends = runs(_INSIDE[data], at)
    owner = np.searchsorted(at, starts, "right") - 1
    stops = np.cumsum(_STOP[data])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[:len(first)] - 1
    sentence = np.cumsum(new) - 1
    term = [span_hashes(data, starts, ends)]
    for k in stems:
        term.append(mix(span_hashes(data, starts, np.minimum(ends, starts + k)) + np.uint64(k)))
    term, sentence = np.concatenate(term), np.tile(sentence, len(stems) + 1)
    _, once = np.unique(mix(term + sentence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once = once[np.argsort(sentence[once], kind="stable")]
    return {"term": term[once], "sentence": sentence[once].astype(np.int32), "owner": owner[first].astype(np.int32),
            "start": starts[first] - at[owner[first]], "end": ends[last] - at[owner[first]]}


def bag(column: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value) of all texts: square roots of the shares of words and of word shapes.

    A shape is a word with its letters and digits reduced to kinds and repeats dropped.  The first two bins hold the
    share of words equal to the one before and of runs of three words met before in the text.
    """
    data, at = buffer(column)
    starts, ends = words(data, at)
    owner = np.searchsorted(at, starts, "right") - 1
    n = np.bincount(owner, minlength=len(at) - 1)
    kinds = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[at[at < len(data)]] = True
    to = np.cumsum(keep)
    hashes = span_hashes(data, starts, ends)
    shapes = span_hashes(kinds[keep], to[starts] - 1, to[ends - 1], fold=False) if len(starts) else hashes
    mask = np.uint64(bins - 1)
    key = np.concatenate([hashes & mask, mix(shapes + np.uint64(1)) & mask]).astype(np.int64)
    key[key < 2] += 2
    row = np.concatenate([owner, owner]).astype(np.int64)
    both, count = np.unique(row * bins + key, return_counts=True)
    text, bin = both // bins, both % bins
    value = np.sqrt(count / n[text])
    same = np.zeros(len(at) - 1)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][again], minlength=len(at) - 1)
    three = np.zeros(len(at) - 1)
    if len(hashes) > 2:
        whole = owner[2:] == owner[:-2]
        run = mix(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(5) + owner[2:].astype(np.uint64))[whole]
        own = owner[2:][whole]
        _, first = np.unique(run, return_index=True)
        three = np.bincount(own, minlength=len(at) - 1) - np.bincount(own[first], minlength=len(at) - 1)
    has = np.flatnonzero(n)
    share = [np.sqrt(x[has] / n[has]) for x in (same, three)]
    return (np.concatenate([text, has, has]).astype(np.int64), np.concatenate([bin, np.zeros(len(has), np.int64), np.ones(len(has), np.int64)]),
            np.concatenate([value, *share]))


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: Column, use: Column, most: int) -> DataFrame:
    """(key, text, label, weight) of about ``most`` labelled documents that ``use`` allows, in equal parts of each label.

    They are chosen by a hash of the key, 2 * ``most`` at the very most, and only their keys are sent to the tasks that
    read the documents.  ``__weight`` is the number of labels that one stands for.  Several labels of a key give their least.
    """
    marked = labels.where(F.col(id).isNotNull() & use).select(F.col(id).alias("__key"), label.alias("__label")).where("__label is not null")
    counts = {r["__label"]: r["count"] for r in marked.groupBy("__label").count().collect()}
    part = {k: min(1.0, most / len(counts) / n) for k, n in counts.items()}
    share = F.coalesce(*[F.when(F.col("__label") == k, F.lit(p)) for k, p in part.items()], F.lit(0.0))
    bits = 1 << 30
    chosen = (marked.where(F.pmod(F.xxhash64("__key", F.lit(11)), F.lit(bits)) < share * bits)
              .groupBy("__key").agg(F.min("__label").alias("__label")).limit(2 * most))
    return (docs.select(F.col(f"`{id}`").alias("__key"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), "__key")
            .select("__key", "__text", "__label", F.when(share > 0, 1 / share).alias("__weight")).limit(2 * most))


class Adam:
    """Steps of the Adam rule for one array."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.mean, self.square, self.steps = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9 ** self.steps), self.square / (1 - 0.999 ** self.steps)
        self.value -= self.rate * mean / (np.sqrt(square) + 1e-8)
