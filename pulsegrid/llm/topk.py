"""Exact search for the k largest inner products over an impact-ordered index, score at a time.

Vectors are integers.  Every task indexes its vectors in blocks: for each dimension, the values are
quantised to levels, and the vectors of a level are a posting segment.  A query processes segments of
all dimensions in descending order of the quantised impact, the most that a value of the level can add to
the score above the least of its dimension.  After each round the segments left bound what a vector
can still gain.  A query stops when only few vectors can still reach the k-th score, which is a proof
for all others, and the possible members are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.vectors import Best, best_of, matrix, query_blocks, usable, usual_size


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, values: np.ndarray, levels: int = 64):
        n, d = values.shape
        self.values, self.n, self.d = values, n, d
        self.low, self.high = values.min(0), values.max(0)
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        level = (values - self.low) // self.step
        self.levels = int(level.max()) + 1
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()  # of each dimension, by level
        sizes = np.zeros((d, self.levels), np.int64)
        np.add.at(sizes, (np.repeat(np.arange(d), n), level.T.ravel()), 1)
        self.sizes = sizes
        self.starts = np.cumsum(sizes, axis=1) - sizes
        self.floor = self.low[:, None] + self.step[:, None] * np.arange(self.levels)
        self.ceiling = np.minimum(self.floor + self.step[:, None] - 1, self.high[:, None])

    def members(self, query: np.ndarray, k: int, least: float, rounds: tuple[float, ...] = (0.6, 0.8, 0.9, 1.0)) -> np.ndarray:
        """All rows that can be among the ``k`` best of this block and score ``least`` or more, and maybe others."""
        a, b = query[:, None] * self.floor, query[:, None] * self.ceiling
        base = np.minimum(query * self.low, query * self.high)
        impact = np.maximum(a, b) - base[:, None]
        loss = int((np.abs(query) * (self.step - 1)).sum())  # the most by which quantised scores are too high
        used = np.flatnonzero(self.sizes.ravel())
        used = used[np.argsort(-impact.ravel()[used], kind="stable")]
        impacts, sizes = impact.ravel()[used], self.sizes.ravel()[used]
        rows, starts = used // self.levels, self.starts.ravel()[used]
        ends = np.cumsum(sizes)
        score = np.full(self.n, float(base.sum()))
        seen = np.zeros(self.n)
        done = 0
        flat = self.order.ravel()
        for share in rounds:
            upto = int(np.searchsorted(ends, share * ends[-1], "left")) + 1 if share < 1 else len(used)
            if upto <= done:
                continue
            s = sizes[done:upto]
            begin = rows[done:upto] * self.n + starts[done:upto]
            at = np.arange(s.sum()) + np.repeat(begin - (np.cumsum(s) - s), s)
            postings = flat[at]
            score += np.bincount(postings, np.repeat(impacts[done:upto], s), self.n)
            seen += np.bincount(postings, minlength=self.n)
            done = upto
            rest = float(impacts[done]) if done < len(used) else 0.0
            highest = score + (self.d - seen) * rest
            # What is left adds nothing less than 0, so a score less the loss is sure.
            reach = max(least, np.partition(score, self.n - k)[self.n - k] - loss) if self.n > k else least
            members = np.flatnonzero(highest >= reach)
            if len(members) <= max(4 * k, self.n // 64):
                break
        return members


def search(df: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 256,
           block: int = 8192, query_block: int = 16384) -> DataFrame:
    """The ``k`` rows of ``df`` with the largest integer inner product with each row of ``queries``, but those of its own id.

    Components become floor(scale * x).  Ties go to the smaller id; there are fewer rows where there are fewer
    candidates.  Vectors that are null, empty, of another than the usual length or hold null or non-finite
    components take no part, nor do rows without an id.  Repeated rows are candidates each; a query's id that
    comes with several vectors is searched once, with the least of them.  ``queries`` is sent to the tasks ``query_block`` rows at a time,
    each time over all of ``df``, and ``block`` rows are indexed together.
    """
    whole = lambda t: t.where(F.col(id).isNotNull() & usable(vector)).select(
        F.col(id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    rows = whole(df)
    size = usual_size(rows, "v")
    rows = rows.where(F.size("v") == size)
    asked = whole(queries).where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = None
    for part in query_blocks(asked, "vec_id", query_block):
        one = rows.mapInArrow(_task(part["vec_id"].to_numpy(), matrix(part["v"], size).astype(np.int64), k, size, block),
                              "query_id bigint, vec_id bigint, score bigint")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    return best_of(found, k)


def _task(names: np.ndarray, asked: np.ndarray, k: int, size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k, np.int64)

        def scan(ids: np.ndarray, values: np.ndarray) -> None:
            index = ImpactIndex(values)
            for q in range(len(names)):
                members = index.members(asked[q], k + int((ids == names[q]).sum()), best.least[q])
                members = members[ids[members] != names[q]]
                scores = values[members] @ asked[q]
                if len(members) > k:
                    top = np.lexsort((ids[members], -scores))[:k]
                    members, scores = members[top], scores[top]
                best.add(np.full(len(members), q), ids[members], scores)
            best.settle()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                held.append(batch.slice(i, block))
                if sum(b.num_rows for b in held) >= block:
                    t = pa.Table.from_batches(held)
                    scan(t["vec_id"].to_numpy(), matrix(t["v"], size).astype(np.int64))
                    held = []
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                scan(t["vec_id"].to_numpy(), matrix(t["v"], size).astype(np.int64))
        query, ids, scores = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores.astype(np.int64))],
                                         names=["query_id", "vec_id", "score"])
    return run
