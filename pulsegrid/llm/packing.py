"""Packing token ids into windows of a fixed size, by the sum-of-squares rule.

Each task packs the documents it reads, so nothing is shuffled and a lost task repeats alone.
A document's full windows are cut off first.  Its rest goes, online, to the fill level that
minimises the sum of the squared numbers of partly filled windows; the level array counts the
windows at each fill.  At the end of a task, or when more than ``most_open`` windows are
open, what is open is cut and joined into full windows; the last remainder becomes windows
of a power of two each, which need no padding.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.hashtable import HashTable
from pulsegrid.llm.texts import buffer, chunks, span_hashes

#: The pre-tokenizer of the byte-level file: fixed value.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

PIECES = ("{id} {type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a byte-level BPE file as bytes; printable bytes stand for themselves, the rest from U+0100 on."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    shifted = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    return {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if all(c in byte for c in word)}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space, mark, letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    space[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    mark[list(b".,!?;:|")] = True
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    return space, mark, letter


_SPACE, _MARK, _LETTER = _classes()


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places, those of ``at`` included, where texts can be cut without cutting a token.

    They are before a single space or around a single line feed that stands between two characters,
    and between a Latin letter and a mark.  Bytes that may belong to wide white space count as white space.
    """
    n = len(data)
    d = np.zeros(n + 4, np.uint8)
    d[3:n + 3] = data
    wide = (d == 0xC2) | ((d >= 0xE1) & (d <= 0xE3))
    blank = _SPACE[d]
    # White space or maybe so: a character seen from its first byte, and one seen from its last byte.
    first = blank | wide
    last = blank.copy()
    last[1:] |= wide[:-1] & (d[1:] >= 0x80)
    last[2:] |= wide[:-2] & (d[2:] >= 0x80) & (d[1:-1] >= 0x80)
    letter = _LETTER[d]
    letter[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] != 0x97) & (d[1:] != 0xB7)
    here = slice(3, n + 3)
    alone = ~last[2:n + 2] & ~first[4:n + 4]
    cut = (d[here] == 0x20) & alone
    line = (d[here] == 0x0A) & alone
    cut |= line
    cut[1:] |= line[:-1]
    cut |= letter[2:n + 2] & _MARK[d[here]]
    inner = at[(at > 0) & (at < n)]
    if len(inner):  # what was judged across the border of two texts
        for k in (-1, 0, 1):
            near = inner + k
            cut[near[(near >= 0) & (near < n)]] = False
    cut[at[at < n]] = True
    return np.flatnonzero(cut)


class Tokens:
    """Ids of a byte-level BPE file.

    A text is cut where no token can span the cut; a piece met before, of which up to ``most``
    are held by their 64-bit hashes, is looked up and any other encoded.  The bytes of the ids are compared with the
    texts, so a hash that two pieces share is noticed.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        import tiktoken

        ranks = byte_ranks(path)
        ranks.pop(b"<|endoftext|>", None)
        self.model = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(b) for b in ranks]
        self.begin = np.cumsum(self.bytes) - self.bytes
        self.spelled = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known = HashTable(1 << 16)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode pieces one after another in one text, and tell them apart by the bytes of their ids."""
        if self.known.size > self.most:
            self.forget()
        fresh = self.known.find(keys) < 0
        if not fresh.any():
            return
        keys, index = np.unique(keys[fresh], return_index=True)
        starts, ends = starts[fresh][index], ends[fresh][index]
        # In one text a piece that begins without its space could grow onto the one before, so these are encoded alone.
        follows = data[starts] == 0x20
        follows &= (ends - starts > 1) & ~_SPACE[data[ends - 1]] & (data[ends - 1] < 0x80)
        follows &= ~_SPACE[data[np.minimum(starts + 1, len(data) - 1)]]
        order = np.argsort(~follows, kind="stable")
        keys, starts, ends = keys[order], starts[order], ends[order]
        n = int(follows.sum())
        lengths = ends[:n] - starts[:n]
        stops = np.cumsum(lengths)
        joined = data[np.arange(stops[-1] if n else 0) + np.repeat(starts[:n] - (stops - lengths), lengths)]
        ids = self.model.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()).astype(np.uint32)
        counts = np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), stops, "right"), prepend=0)
        raw = data.tobytes() if n < len(keys) else b""
        rest = [self.model.encode_ordinary(raw[b:e].decode()) for b, e in zip(starts[n:], ends[n:])]
        counts = np.concatenate([counts, np.array([len(x) for x in rest], np.int64)])
        self.known.add(keys)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids, np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        data, at = buffer(column)
        starts = cuts(data, at)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        keys = span_hashes(data, starts, ends, fold=False)
        self.learn(data, keys, starts, ends)
        where = self.known.find(keys).astype(np.int64)
        begin, count = self.first[where], self.first[where + 1] - self.first[where]
        stop = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - stop[:-1], count)]
        if not np.array_equal(self.decode(ids), data):  # a piece that has the hash of another one
            texts = [data[b:e].tobytes().decode() for b, e in zip(at[:-1], at[1:])]
            return [np.array(self.model.encode_ordinary(t), np.uint32) for t in texts]
        border = stop[np.searchsorted(starts, at)]
        return [ids[b:e] for b, e in zip(border[:-1], border[1:])]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        n = self.bytes[ids]
        upto = np.cumsum(n)
        return self.spelled[np.arange(upto[-1] if len(n) else 0) + np.repeat(self.begin[ids] - (upto - n), n)]


class Packer:
    """Windows of one task.  A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.done: list[list[tuple]] = []

    def place(self, piece: tuple) -> None:
        """Put a piece shorter than a window where the sum of squares grows least; the fuller window wins a tie."""
        s, c = len(piece[2]), self.counts
        grow = np.full(self.size + 1 - s, np.iinfo(np.int64).max)
        levels = np.arange(self.size + 1 - s)
        used = c[:self.size + 1 - s] > 0
        grow[used] = 2 * (c[levels[used] + s] - c[levels[used]]) + 2
        if used[-1]:
            grow[-1] = 1 - 2 * c[self.size - s]
        grow[0] = 2 * c[s] + 1
        h = len(grow) - 1 - int(np.argmin(grow[::-1]))
        window = self.windows[h].pop() if h else []
        self.counts[h] -= 1 if h else 0
        self.open += 0 if h else 1
        window.append(piece)
        if h + s == self.size:
            self.done.append(window)
            self.open -= 1
        else:
            self.windows[h + s].append(window)
            self.counts[h + s] += 1
        if self.open > self.most_open:
            self.join()

    def add(self, doc, ids: np.ndarray) -> None:
        full = len(ids) // self.size * self.size
        for b in range(0, full, self.size):
            self.done.append([(doc, b, ids[b:b + self.size], len(ids))])
        if full < len(ids):
            self.place((doc, full, ids[full:], len(ids)))

    def join(self, last: bool = False) -> None:
        """Cut open windows and join them into full ones; at the end also into powers of two."""
        pieces = [p for level in self.windows for w in level for p in w]
        self.windows = [[] for _ in range(self.size + 1)]
        self.counts[:], self.open = 0, 0
        window, room = [], self.size
        left = sum(len(p[2]) for p in pieces)
        for doc, start, ids, n in pieces:
            while len(ids):
                if not window:
                    if left >= self.size:
                        room = self.size
                    elif last:
                        room = 1 << (left.bit_length() - 1)
                    else:
                        room = left
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], n))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    fill = sum(len(p[2]) for p in window)
                    if fill == self.size or last:
                        self.done.append(window)
                    else:
                        self.windows[fill].append(window)
                        self.counts[fill] += 1
                        self.open += 1
                    window = []

    def take(self) -> list[list[tuple]]:
        done, self.done = self.done, []
        return done


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", size: int = 1024,
         end: int = 0, most_open: int = 2048) -> DataFrame:
    """Pieces of all documents: id, start, length, ids (unsigned, little-endian 32 bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text and then ``end``; a null or empty text has that id alone.
    Repeated rows and null ids are documents like any other.  ``sequence_id`` holds the task's number in its
    upper bits.  An empty table gives no rows; other columns are not read.
    """
    if size < 1:
        raise ValueError("size must be positive")
    key = df.schema[id].dataType.simpleString()
    source = df.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def rows(windows: list[list[tuple]], at: int, id_type: pa.DataType) -> pa.RecordBatch:
        flat = [(p, at + i) for i, w in enumerate(windows) for p in w]
        lengths = np.array([len(p[2]) for p, _ in flat], np.int64)
        seq = np.array([s for _, s in flat], np.int64)
        before = np.cumsum(lengths) - lengths
        head = np.concatenate([[True], seq[1:] != seq[:-1]])
        offset = before - np.maximum.accumulate(np.where(head, before, 0))
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p, _ in flat], id_type), pa.array([p[1] for p, _ in flat], pa.int64()),
            pa.array(lengths), pa.array([p[2].astype("<u4").tobytes() for p, _ in flat], pa.binary()),
            pa.array([p[3] for p, _ in flat], pa.int64()), pa.array(seq), pa.array(offset)],
            names=[id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = None, Packer(size, most_open)
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 36
        id_type = pa.int64()
        for batch in chunks(batches, "__text"):
            tokens = tokens or Tokens(tokenizer)
            id_type = batch.schema.field("__id").type
            for doc, ids in zip(batch.column("__id").to_pylist(), tokens.encode(batch.column("__text"))):
                packer.add(doc, np.append(ids, np.uint32(end)))
            if packer.done:
                windows = packer.take()
                yield rows(windows, at, id_type)
                at += len(windows)
        packer.join(last=True)
        if packer.done:
            yield rows(packer.take(), at, id_type)

    return source.mapInArrow(run, PIECES.format(id=f"`{id}`", type=key))
