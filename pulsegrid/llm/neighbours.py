"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample on the driver; every row is then put into a leaf.  A query
opens nodes from a priority queue, the most promising first, and visits leaves in the order in which they
come.  How many leaves are visited is widened, on queries of the sample, until the recall asked for is
reached.  Every query's visits are computed once, as rows (leaf, query), and meet the rows of the leaf in a task that
holds the visitors and reads the rows past them; leaves with many rows or visitors are dealt in blocks to several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.vectors import Best, best_of, matrix, usable, usual_size
from pulsegrid.session import written


def kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` groups, started from distinct points far apart by chance."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        count = np.bincount(own, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


@dataclass
class Tree:
    """Centres of all nodes, children of each (none for a leaf), and the number of each leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    leaf: list[int] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    below: list[tuple[np.ndarray, np.ndarray] | None] = field(default_factory=list)

    @classmethod
    def fit(cls, points: np.ndarray, branching: int, leaf_rows: int, rounds: int = 8, seed: int = 7) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)

        def grow(own: np.ndarray, centre: np.ndarray) -> int:
            node = len(tree.centres)
            tree.centres.append(centre)
            tree.spread.append(float(np.sqrt(((own - centre) ** 2).sum(1).mean())))
            tree.children.append([])
            tree.leaf.append(-1)
            centres = kmeans(own, branching, rounds, rng) if len(own) > leaf_rows else centre[None]
            if len(centres) > 1:
                to = nearest(own, centres)
                tree.children[node] = [grow(own[to == c], centres[c]) for c in range(len(centres)) if (to == c).any()]
            if not tree.children[node]:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
            return node

        grow(points, points.mean(0))
        return tree.finished()

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, by the nearest centre at every level."""
        out = np.empty(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            children = self.children[node]
            if not children:
                out[own] = self.leaf[node]
                continue
            to = nearest(points[own], np.stack([self.centres[c] for c in children]))
            todo += [(child, own[to == i]) for i, child in enumerate(children) if (to == i).any()]
        return out

    def finished(self) -> Tree:
        """Keep, for each inner node, the centres and spreads of its children together."""
        self.below = [(np.stack([self.centres[c] for c in cs]), np.array([self.spread[c] for c in cs])) if cs else None for cs in self.children]
        return self

    def visits(self, query: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves, best bin first: by the inner product that a far row of the bin could have."""
        length = float(np.sqrt(query @ query))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.below[node] is None:
                out.append(self.leaf[node])
                continue
            centres, spread = self.below[node]
            for c, p in zip(self.children[node], (-(centres @ query) - length * spread).tolist()):
                heapq.heappush(queue, (p, c))
        return np.array(out, np.int32)


def widen(tree: Tree, points: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The number of leaves to visit for ``recall`` of the ``k`` best, over queries of the sample."""
    asked = np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int)
    leaf = tree.assign(points)
    position = np.empty((len(asked), min(k, max(1, len(points) - 1))), np.int64)
    for i, q in enumerate(asked):
        scores = points @ points[q]
        scores[q] = -np.inf
        order = np.full(tree.leaves, tree.leaves)
        first = tree.visits(points[q], tree.leaves)
        order[first] = np.arange(len(first))
        position[i] = order[leaf[np.argsort(-scores)[:position.shape[1]]]]
    reached = np.cumsum(np.bincount(position.ravel(), minlength=tree.leaves + 1)) / position.size
    return min(tree.leaves, int(np.argmax(reached >= recall)) + 1)


def search(df: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", recall: float = 0.97,
           sample: int = 16384, branching: int = 16, leaf_rows: int = 1024, block: int = 8192) -> DataFrame:
    """The ``k`` nearest found of each row of ``queries``, by inner product in double precision, but those of its own id.

    Ties go to the smaller id; there are fewer rows where there are fewer candidates.  Vectors that are null,
    empty, zero, of another than the usual length or hold null or non-finite components take no part, nor do rows without an id.
    Repeated rows are candidates each; a query's id that comes with several vectors is searched with the least of
    them.  About ``sample`` rows fit the tree and calibrate the visits; all rows are indexed.  The tree is split until a leaf stands for
    about ``leaf_rows`` rows of the table, within 128 to a sixteenth of ``sample`` leaves.  A leaf with more than ``block`` rows or
    visitors is dealt in blocks to several tasks.
    """
    spark = df.sparkSession
    whole = lambda t: t.where(F.col(id).isNotNull() & usable(vector, zero=False)).select(
        F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = whole(df)
    size = usual_size(rows, "v")
    if not size:
        return empty
    rows = rows.where(F.size("v") == size)
    total = rows.count()
    bits = 1 << 30
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(bits)) < int(bits * min(1.0, sample / total))).limit(2 * sample).toArrow()
    if not some.num_rows:
        some = rows.limit(sample).toArrow()
    points = matrix(some["v"], size)[np.argsort(some["vec_id"].to_numpy(), kind="stable")]
    leaves = min(max(128, total // leaf_rows), max(128, sample // 16))
    tree = Tree.fit(points, branching, max(1, len(points) // leaves))
    most = widen(tree, points, k, recall)
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(tree.assign(matrix(b.column("v"), size)))],
                                             names=["vec_id", "v", "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                seen = [tree.visits(q, most) for q in matrix(part.column("v"), size)]
                who = pa.array(np.repeat(np.arange(len(seen)), [len(x) for x in seen]))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(who), part.column("v").take(who), pa.array(np.concatenate(seen))],
                                                 names=["vec_id", "v", "leaf"])

    table = f"vec_id bigint, v {kind}, leaf int"
    index = written(rows.mapInArrow(place, table), "leaves")
    asked = whole(queries).where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))
    visits = written(asked.repartition(1 + total // 2048).mapInArrow(visit, table), "visits")
    blocks = lambda t, c: t.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    dealt = F.broadcast(written(blocks(index, "of_rows").join(blocks(visits, "of_visits"), "leaf"), "dealt"))  # one row for each leaf
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(dealt, "leaf").select("leaf", each("of_rows").alias("r"), one("of_visits").alias("q"), F.lit(0).alias("kind"), "vec_id", "v")
    right = index.join(dealt, "leaf").select("leaf", one("of_rows").alias("r"), each("of_visits").alias("q"), F.lit(1).alias("kind"), "vec_id", "v")
    key = ["leaf", "r", "q"]
    met = left.unionAll(right).repartition(*key).sortWithinPartitions(*key, "kind")
    return best_of(met.mapInArrow(_scored(k, size), "query_id bigint, vec_id bigint, score double"), k)


class _Found:
    """The best of all queries that a task has met, cut to ``k`` each when there are many rows."""

    def __init__(self, k: int, room: int = 1 << 19):
        self.k, self.room, self.parts, self.held = k, room, [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.held += len(query)
        if self.held > self.room:
            self.cut()
            self.room = max(self.room, 2 * self.held)

    def cut(self) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        new = np.ones(len(query), bool)
        new[1:] = query[1:] != query[:-1]
        at = np.arange(len(query))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < self.k
        self.parts, self.held = [(query[keep], ids[keep], scores[keep])], int(keep.sum())

    def batch(self) -> pa.RecordBatch:
        if self.parts:
            self.cut()
        query, ids, scores = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _scored(k: int, size: int, at_once: int = 256, most_held: int = 1 << 21):
    """Scores of the rows of every (leaf, r, q) against the visitors of it, which come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(k)
        here, names, asked, best, held = None, [], [], None, []

        def close() -> None:
            nonlocal best
            if best is not None:
                query, ids, scores = best.settle()
                found.add(held[0][query], ids, scores.astype(np.float64))
            best = None

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(c).to_numpy() for c in ("leaf", "r", "q", "kind")])
            border = np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1
            ids, points = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), size)
            for b, e in zip([0, *border], [*border, batch.num_rows]):
                key = tuple(part[:3, b].tolist())
                if key != here:
                    close()
                    here, names, asked = key, [], []
                    if found.held > most_held:
                        yield found.batch()
                if part[3, b] == 0:
                    names.append(ids[b:e])
                    asked.append(points[b:e])
                    continue
                if not names:
                    continue
                if best is None:
                    held = (np.concatenate(names), np.concatenate(asked))
                    best = Best(len(held[0]), k)
                for i in range(b, e, at_once):
                    scores = held[1] @ points[i:min(e, i + at_once)].T
                    x, y = np.nonzero(scores >= best.least[:, None])
                    other = held[0][x] != ids[i + y]
                    x, y = x[other], y[other]
                    best.add(x, ids[i + y], scores[x, y])
        close()
        yield found.batch()
    return run
