"""Texts of an Arrow batch as one byte array, and 64-bit hashes of their words.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as a-z where
a function says so.  Everything works on the UTF-8 bytes Arrow already holds, in pieces of
bounded size, so that one very long text does not multiply its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest span that is hashed by blocks of 8 bytes.
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, _INVERSE, np.uint64)
    up[:1], down[:1] = 1, 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is alone in its batch."""
    for batch in batches:
        _, at = buffer(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; none crosses the border between two texts."""
    inside = ~_SPACE[data]
    borders = at[(at > 0) & (at < len(data))]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[borders] = False
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each of many spans.

    Blocks of 8 bytes go one after another through ``mix``, which is one to one: different spans of one length up to 8 bytes never
    have one hash, and longer ones only by chance.  Spans of more than LONG bytes are hashed by BLAKE2b.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if fold else data
    blocks = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    length = ends - starts
    out = mix((length.astype(np.uint64) + np.uint64(1)) * _BASE)
    left = np.flatnonzero(length <= LONG)
    at, rest = starts[left], length[left]
    while len(left):
        block = blocks[at] & _FIRST[np.minimum(rest, 8)]
        out[left] = mix(out[left] * _BASE + block)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i]:ends[i]].data, digest_size=8).digest(), "little")
    return out


def word_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the position in them where each text begins."""
    data, at = buffer(column)
    starts, ends = words(data, at)
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``width`` words, or of all its words where there are fewer."""
    hashes, first = word_table(column)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        runs += hashes[k:k + len(runs)] * weights[k]
    runs = mix(runs)
    out = []
    for b, e in zip(first[:-1], first[1:]):
        n = e - b
        if n >= width:
            out.append(np.unique(runs[b:e - width + 1]))
        elif n:
            short = (hashes[b:e] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
