"""Vectors in Arrow batches as matrices, bounded blocks of queries, and best-k lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: str, zero: bool = True) -> Column:
    """Whether a vector is neither null nor empty and holds finite numbers only (and one that is not 0)."""
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ok if zero else ok & F.exists(vector, lambda x: x != 0)


def usual_size(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the smaller of two as frequent; 0 for none."""
    got = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return int(got[0]["n"]) if got else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` numbers as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def query_blocks(queries: DataFrame, id: str, most: int) -> Iterator[pa.Table]:
    """All rows of ``queries`` in tables of about ``most`` rows, dealt by a hash of the id, one at a time on the driver."""
    n = queries.count()
    parts = -(-n // most)
    for k in range(parts):
        part = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(id), F.lit(parts)) == k)
        yield part.toArrow()


class Best:
    """The ``k`` best (score, id) of each of many queries; of equal scores the smaller id."""

    def __init__(self, queries: int, k: int, kind=np.float64, room: int = 400_000):
        self.k, self.room, self.queries = k, room, queries
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.least = np.full(queries, -np.inf)  # no lower score can enter
        self.kind = kind

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.held += len(query)
        if self.held > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        self.least[query[rank == self.k - 1]] = scores[rank == self.k - 1]
        keep = rank < self.k
        self.parts = [(query[keep], ids[keep], scores[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of each query among the bests of all tasks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
