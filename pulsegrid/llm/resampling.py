"""Importance resampling towards a target distribution, with hashed runs of words as features.

Features are the runs of 1 to 3 consecutive words, in buckets by CRC-32 (``crc.py``).  The corpus and the target texts
are counted by bucket; a document's weight is the sum of its features' log ratios, and a Gumbel draw that depends on its
id alone turns the weights into a sample without replacement: the highest sums of weight and draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.crc import crc32
from pulsegrid.llm.features import runs
from pulsegrid.llm.texts import _LOWER, buffer, chunks
from pulsegrid.session import discard, written

BUCKETS, LONGEST = 10_000, 3

#: Bytes of words: digits, letters (A-Z counted as a-z) and all of code points above U+007F.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with one space between words, start and end of each word in them, and the words before each text."""
    data, at = buffer(column)
    data = _LOWER[data]
    inside = _INSIDE[data]
    starts, ends = runs(inside, at)
    keep = inside.copy()
    gaps = ends[ends < len(data)]
    keep[gaps] = True  # the byte after a word becomes the space; where a text begins there, it is the text's own
    place = np.concatenate([[0], np.cumsum(keep)])
    out = data[keep]
    space = gaps[~inside[gaps]]
    out[place[space]] = 0x20
    return out, place[starts], place[ends], np.searchsorted(starts, at)


def features(column: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: bucket of every run in order, and the number of runs before each text."""
    data, starts, ends, first = _joined(column)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(longest):
        n = max(0, len(starts) - k)
        whole = owner[:n] == owner[k:k + n]
        crc = crc32(data, starts[:n][whole], ends[k:k + n][whole])
        yield crc % np.uint32(buckets), np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - k, 0))])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket; each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches):
            for bucket, _ in features(batch.column("text"), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            count, weight = np.zeros((2, batch.num_rows), np.int64)
            words = None
            for bucket, first in features(batch.column("text"), len(gain), longest):
                upto = np.concatenate([[0], np.cumsum(gain[bucket])])
                weight += np.diff(upto[first])
                count += np.diff(first)
                words = np.diff(first) if words is None else words
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = "42") -> Column:
    """floor(-1000 ln(-ln(u))) with u in (0, 1) from the first 32 bits of sha256(seed:doc_id); a null id is empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ranks count the drawn ones from 1, others have none.

    ``docs`` has doc_id and text, ``target`` text; other columns are ignored.  Of the N documents with at least
    ``least_words`` words, floor(percent * N / 100) are drawn: highest score, then smallest doc_id (null last).
    Rows that repeat a document are documents of their own with the same score, and the order among them says nothing.
    A null or empty text has no features, weight 0 and no rank; an empty table gives no rows.  The drawn are ordered by
    a range-partitioned sort, and a rank is a row's place in its partition after the rows of earlier partitions.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(target.select(F.col("text").cast("string").alias("text")), buckets))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    place = F.monotonically_increasing_id()  # partition, then place in it
    ordered = enough.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "n_features", "weight", "score", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    ordered = written(ordered, "ordered")
    drawn = percent * ordered.count() // 100
    before = ordered.groupBy("part").count().select(  # one row for each partition
        "part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    ranked = ordered.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    short = scored.where(F.col("n_words") < least_words)
    return ranked.unionAll(short.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
