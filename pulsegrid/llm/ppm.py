"""Language-model scores by prediction by partial matching over bytes, with a word-count baseline.

The model is a trie of byte contexts of up to ``ORDER`` bytes.  Its deepest level, the counts of runs of
ORDER + 1 bytes, is counted over all training texts and summed by a shuffle; the levels above are sums of it.
A byte is looked for in its longest known context first.  Where the context has not seen it, the
escape (method C: as many chances as there are distinct symbols) leads to the next shorter one, in which the symbols
of the longer are excluded.  Below the empty context, the byte values left are equally likely.  Byte 0xFF, which no text holds,
stands before a text and ends it.

Tables that tasks need are sent in shards of at most ``most`` entries, one shard to a pass over the texts: runs of bytes by the last two
bytes of their context, which all longer contexts of a place share, and words by their hash.  Each place and each word belongs to
one shard, and the passes' sums are added, so the size of the model is not limited by a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.hashtable import HashTable
from pulsegrid.llm.texts import _LOWER, buffer, chunks, span_hashes, words
from pulsegrid.session import written

ORDER = 5
EDGE = 0xFF

RUN, WORD = 0, 1


def byte_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte of each text and at its end, and where each text begins in them."""
    length = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(length + ORDER + 1)])
    s = np.full(begin[-1], EDGE, np.uint8)
    own = np.arange(len(data)) + np.repeat((np.arange(len(length)) + 1) * (ORDER + 1) - 1, length)
    s[own] = _LOWER[data]
    key = np.zeros(max(0, len(s) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        key = (key << np.uint64(8)) | s[j:j + len(key)]
    first = np.concatenate([[0], np.cumsum(length + 1)])
    where = np.arange(first[-1]) + np.repeat(begin[:-1] - first[:-1], length + 1)
    return key[where], first


class Counter:
    """Counts of 64-bit keys, handed out when there are many."""

    def __init__(self, room: int = 2 << 20):
        self.room = room
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, count = np.unique(keys, return_counts=True)
        both = np.concatenate([self.keys, new])
        self.keys, to = np.unique(both, return_inverse=True)
        self.counts = np.bincount(to, np.concatenate([self.counts, count]), len(self.keys)).astype(np.int64)

    def rows(self, kind: int, last: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.keys) and (last or len(self.keys) > self.room):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), kind, np.int8)), pa.array(self.keys.view(np.int64)),
                                              pa.array(self.counts)], names=["kind", "key", "n"])
            self.__init__(self.room)


def count(docs: DataFrame, text: str) -> DataFrame:
    """(kind, key, n): counts of all byte runs and all words of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, terms = Counter(), Counter()
        for batch in chunks(batches, "__text"):
            data, at = buffer(batch.column("__text"))
            runs.add(byte_runs(data, at)[0])
            terms.add(span_hashes(data, *words(data, at)))
            yield from runs.rows(RUN)
            yield from terms.rows(WORD)
        yield from runs.rows(RUN, last=True)
        yield from terms.rows(WORD, last=True)

    return (docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "kind tinyint, key bigint, n bigint")
            .groupBy("kind", "key").agg(F.sum("n").alias("n")))


@dataclass
class Level:
    """Contexts of one order, sorted, with their symbols."""

    runs: np.ndarray  # context and symbol
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray  # of each context: the sum of its symbols' counts,
    distinct: np.ndarray  # how many symbols it has,
    shorter: np.ndarray  # and the sum of these symbols' counts in the next shorter context


def levels(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> list[Level]:
    """All orders from 0 on: orders 0 and 1 from the whole model's ``pairs`` of bytes, the others from a shard's runs."""
    out: list[Level] = []
    for order in range(ORDER + 1):
        source, n = (pairs, pair_counts) if order < 2 else (runs, counts)
        cut = source & np.uint64((1 << 8 * (order + 1)) - 1)
        key, to = np.unique(cut, return_inverse=True)
        c = np.bincount(to, n, len(key))
        context, at = np.unique(key >> np.uint64(8), return_inverse=True)
        size = len(context)
        shorter = np.zeros(size)
        if order:
            above = out[-1]
            parent = key & np.uint64((1 << 8 * order) - 1)
            shorter = np.bincount(at, above.counts[np.searchsorted(above.runs, parent)], size)
        out.append(Level(key, c, context, np.bincount(at, c, size), np.bincount(at, minlength=size), shorter))
    return out


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Trie:
    """log10 probability of the last byte of a run, given the bytes before it."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        self.levels = levels(runs, counts, pairs, pair_counts)
        top = self.levels[ORDER]
        self.table = HashTable(max(8, len(top.runs)))
        self.table.add(top.runs + np.uint64(1))  # the table's keys are not 0
        at = _place(top.contexts, top.runs >> np.uint64(8))
        self.known = np.log10(top.counts / (top.total + top.distinct)[at]) if len(at) else np.zeros(0)

    def log10(self, runs: np.ndarray) -> np.ndarray:
        at = self.table.find(runs + np.uint64(1))
        out = self.known[np.maximum(at, 0)] if len(self.known) else np.zeros(len(runs))
        rare = at < 0
        if rare.any():
            distinct, to = np.unique(runs[rare], return_inverse=True)
            out[rare] = self.escaped(distinct)[to]
        return out

    def escaped(self, runs: np.ndarray) -> np.ndarray:
        """The same, by way of all orders."""
        out = np.zeros(len(runs))
        open_ = np.ones(len(runs), bool)
        excluded, fewer = np.zeros(len(runs)), np.zeros(len(runs))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            run = runs & np.uint64((1 << 8 * (order + 1)) - 1)
            context = _place(level.contexts, run >> np.uint64(8))
            known = open_ & (context >= 0)
            at = np.where(known, _place(level.runs, run), -1)
            c = np.maximum(context, 0)
            if not len(level.contexts):
                continue
            total, symbols = level.total[c] - excluded, level.distinct[c] - fewer
            hit = at >= 0
            out[hit] += np.log10(level.counts[at[hit]] / (total + symbols)[hit])
            open_ &= ~hit
            escape = known & ~hit & (symbols > 0)
            out[escape] += np.log10(symbols[escape] / (total + symbols)[escape])
            known &= ~hit
            excluded = np.where(known, level.shorter[c], excluded)
            fewer = np.where(known, level.distinct[c], fewer)
        seen = len(self.levels[0].runs)
        out[open_] -= np.log10(256 - seen) if seen < 256 else 0.0
        return out


def score(docs: DataFrame, use: Column, text: str = "text", most: int = 2 << 20) -> DataFrame:
    """All rows with n_tokens, n_known, train_tokens, base_score and score, learned from the rows that ``use`` allows.

    Tokens are words, A-Z as a-z, and one end for each text.  base_score adds log10((c + 1) / (N + V + 1)) over them, with c the
    token's count, N all and V distinct tokens in training; n_known counts those with c > 0.  score is the model's log10
    probability of the text's bytes and its end.  A null text is empty and has the end alone.  Without training
    rows every byte has probability 1/256.  Columns of these names are replaced; other columns and repeated rows stay.
    """
    spark = docs.sparkSession
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    learned = docs.where(F.coalesce(use, F.lit(False)))
    counts = written(count(learned, text), "counts")
    ends = learned.count()
    sums = {r["kind"]: (r["entries"], r["n"]) for r in counts.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("n").alias("n")).collect()}
    (runs, _), (distinct, tokens) = sums.get(RUN, (0, 0)), sums.get(WORD, (0, 0))
    tokens, distinct = tokens + ends, distinct + (1 if ends else 0)
    pairs = (counts.where(F.col("kind") == RUN).groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair"))
             .agg(F.sum("n").alias("n")).toArrow())
    pair, pair_n = pairs["pair"].to_numpy().astype(np.uint64), pairs["n"].to_numpy().astype(np.float64)
    order = np.argsort(pair)
    pair, pair_n = pair[order], pair_n[order]
    run_shards, word_shards = max(1, -(-runs // most)), max(1, -(-distinct // most))

    keep = [c for c in docs.columns if c not in added or c == text]
    final = [c for c in keep if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__row"))
    slim = rows.select("__row", F.col(f"`{text}`").alias("__text"))
    passes = max(run_shards, word_shards)
    found = None
    for k in range(passes):
        tables = []
        for kind, shards, of in ((RUN, run_shards, F.shiftright("key", 8).bitwiseAND(0xFFFF)), (WORD, word_shards, F.col("key"))):
            part = counts.where(F.col("kind") == kind)
            if k >= shards:
                tables.append(None)
                continue
            if shards > 1:
                part = part.where(F.pmod(F.xxhash64(of), F.lit(shards)) == k)
            got = part.select("key", "n").toArrow()
            keys = got["key"].to_numpy().astype(np.int64).view(np.uint64)
            by_key = np.argsort(keys)
            tables.append((keys[by_key], got["n"].to_numpy()[by_key]))
        sent = spark.sparkContext.broadcast((tables[0], tables[1], pair, pair_n))
        mine = _shard_of(spark, run_shards, k)
        one = slim.mapInArrow(_pass(sent, mine, k == 0, ends), "__row bigint, tokens bigint, known bigint, logs double, score double")
        found = one if found is None else found.unionAll(one)
    if passes > 1:
        found = found.groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "logs", "score")])
    return rows.select(*[F.col(f"`{c}`") for c in final], "__row").join(found, "__row").select(
        *[F.col(f"`{c}`") for c in final], F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"),
        F.col("score").alias("score"))


def _shard_of(spark, shards: int, k: int) -> np.ndarray | None:
    """Which pairs of context bytes belong to shard ``k``, as the shuffle's hash deals them; None for all."""
    if shards == 1:
        return np.ones(1 << 16, bool) if k == 0 else np.zeros(1 << 16, bool)
    got = spark.range(1 << 16).where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k).toArrow()
    out = np.zeros(1 << 16, bool)
    out[got["id"].to_numpy()] = True
    return out


def _pass(sent, mine: np.ndarray, first: bool, ends: int):
    """Sums of one shard for every text; the first pass also counts the tokens and the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, terms, pair, pair_n = sent.value
        trie = Trie(*(runs or (np.zeros(0, np.uint64), np.zeros(0))), pair, pair_n) if mine.any() else None
        table = None
        if terms is not None:
            table = HashTable(max(8, len(terms[0])))
            table.add(terms[0])
            log = np.append(np.log10(terms[1] + 1.0), 0.0)
        for batch in chunks(batches, "__text"):
            data, at = buffer(batch.column("__text"))
            n = batch.num_rows
            starts, stops = words(data, at)
            begin = np.searchsorted(starts, at)
            known, logs, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if table is not None:
                place = table.find(span_hashes(data, starts, stops))
                owner = np.repeat(np.arange(n), np.diff(begin))
                known = np.bincount(owner, place >= 0, n).astype(np.int64)
                logs = np.bincount(owner, log[place], n).astype(float)
            if trie is not None:
                keys, head = byte_runs(data, at)
                owner = np.repeat(np.arange(n), np.diff(head))
                if not mine.all():
                    own = mine[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
                    keys, owner = keys[own], owner[own]
                score = np.bincount(owner, trie.log10(keys), n).astype(float)
            tokens = np.zeros(n, np.int64)
            if first:
                tokens = np.diff(begin) + 1
                known += 1 if ends else 0
                logs += np.log10(ends + 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(tokens), pa.array(known), pa.array(logs), pa.array(score)],
                                             names=["__row", "tokens", "known", "logs", "score"])
    return run
