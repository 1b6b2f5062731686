"""Removal of repeated passages by a logarithmic family of sampled suffix indexes.

Wanted is every byte covered by a string of ``length`` bytes that starts in more than one place of all texts.  Every such string
contains an anchor, the place of least hash among its runs of ``gram`` bytes, and equal strings have their anchor at the same
offset.  So only the suffixes at anchors are indexed, about two for every ``length - gram`` bytes, in the order of the hash of their first ``gram`` bytes:
suffixes with a long match stand together.

Documents come in batches, in one call or over time (``Family``).  A batch gets its own sorted array, is scanned against the sorted arrays of
all levels for suffixes that begin alike, and becomes the lowest level; two levels of equal size merge into one of twice the size, so a suffix
is merged a logarithmic number of times.  Suffixes that nothing met before are not read again until the matches are resolved.

The suffixes that matched are then resolved exactly.  An anchor speaks for the strings whose least run it is, which start in a
range.  Where the whole stretch that the range covers occurs again, all of it is repeated.  Otherwise the stretches that share
an anchor's run are cut into pieces of ``PIECE`` starts, counted from the anchor, and what all strings of a piece share is the run
of that piece: it is again repeated as a whole, or met nowhere else, or open.  Only open pieces are compared string by string, by
counts of the hashes of all their strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.texts import _SPACE, _VALUE, buffer, chunks, mix, powers
from pulsegrid.session import discard, new_path, written

#: Bits of a packed key that hold a place; a piece of text that is searched at once is shorter.
PLACE = 22
#: Bytes of text whose anchors are found at once: their hashes and sorted windows take some 100 times as much.
AT_ONCE = 1 << 18
#: Rows whose numbers are sent to the tasks that read texts; beyond it the texts are joined by a shuffle.
SENT = 1 << 20
#: Starts in a piece of a stretch, the smallest unit but single strings that is compared.
PIECE = 16

_SUFFIXES = "run bigint, stretch bigint, row bigint, low bigint, back smallint, wide smallint, times tinyint"
_SUFFIX = [c.split()[0] for c in _SUFFIXES.split(", ")]

_ROLL: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash and the inverse powers that shift them."""
    room = 1 << max(16, int(len(data)).bit_length())
    if room not in _ROLL:
        _ROLL.clear()
        _ROLL[room] = powers(room)
    up, down = _ROLL[room]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:len(data)], out=sums[1:])
    return sums, down


def hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts])


def least_in_window(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, size)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[size - 1:size - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all texts: text, first and last start of the strings they stand for, place, hash of the run and of the stretch."""
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "low", "high", "place", "run", "stretch")}
    sums, down = rolled(data)
    place = np.arange(len(data) - gram + 1)
    run = hashes(sums, down, place, place + gram)
    packed = (mix(run + np.uint64(1)) & ~np.uint64((1 << PLACE) - 1)) | place.astype(np.uint64)
    least = (least_in_window(packed, length - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    sizes = np.diff(at)
    room = np.maximum(sizes - length + 1, 0)
    start = np.arange(room.sum()) + np.repeat(at[:-1] - (np.cumsum(room) - room), room)
    text = np.repeat(np.arange(len(sizes)), room)
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[:len(first)] - 1
    text, low, high, anchor = text[first], start[first], start[last], anchor[first]
    stretch = mix(hashes(sums, down, low, high + length) + ((anchor - low) * 1024 + (high - low)).astype(np.uint64))
    begin = at[text]
    return {"text": text, "low": low - begin, "high": high - begin, "place": anchor - begin, "run": run[anchor], "stretch": stretch}


def pieces(batch: pa.RecordBatch, text: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, rows of the batch, bytes before) of texts in pieces; a very long text comes in overlapping parts."""
    data, at = buffer(batch.column(text))
    part = 1 << (PLACE - 2)
    if batch.num_rows == 1 and len(data) > 2 * part:
        for s in range(0, len(data) - length + 1, part):
            some = data[s:s + part + length - 1]
            yield some, np.array([0, len(some)]), np.zeros(1, np.int64), s
    else:
        yield data, at, np.arange(batch.num_rows), 0


def sampled(docs: DataFrame, length: int, gram: int, at_once: int = 1 << 20) -> DataFrame:
    """(row, low, back, wide, run, stretch, times) of all anchors of the rows (row, text).

    The anchor is ``back`` bytes after ``low`` and stands for ``wide`` + 1 starts.  Of equal stretches met in one task one has times 2
    and the others 0: they are repeated, whatever is found elsewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            names = list(held[0])
            all_ = {k: np.concatenate([h.pop(k) for h in held]) for k in names}
            key = mix(all_["run"] + all_["stretch"] * np.uint64(3))
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            times = np.ones(len(key), np.int8)
            times[order[same - 1]] = 2
            times[order[same]] = 0  # all but the first
            del key, order, same
            for k in ("run", "stretch"):
                all_[k] = all_[k].view(np.int64)
            for b in range(0, len(times), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[b:b + (1 << 16)]) for c in (*all_.values(), times)], names=[*names, "times"])

        for batch in chunks(batches, "text", AT_ONCE):
            names = batch.column("row").to_numpy()
            for data, at, which, before in pieces(batch, "text", length):
                found = anchors(data, at, length, gram)
                if not len(found["text"]):
                    continue
                low = found["low"]
                held.append({"row": names[which[found["text"]]], "low": low + before, "back": (found["place"] - low).astype(np.int16),
                             "wide": (found["high"] - low).astype(np.int16), "run": found["run"], "stretch": found["stretch"]})
                size += len(low)
            if size > at_once:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return docs.mapInArrow(run, "row bigint, low bigint, back smallint, wide smallint, run bigint, stretch bigint, times tinyint")


class Family:
    """Suffix arrays of all batches so far, in a folder that outlives the call.

    An array holds suffixes (run, stretch, row, low, back, wide, times), range-sorted by run and stretch; the one of rank r
    holds 2**r batches, so after n batches the ranks are the binary digits of n.  The folder of one that was made before is opened
    again with its number of ``batches``.  A batch whose ``add`` failed can be added again: files that are in use go last.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, batches: int = 0, length: int = 400, gram: int = 200):
        self.spark, self.length, self.gram = spark, length, gram
        self.folder = folder or new_path(spark, "family")
        self.batches = batches

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/pulsegrid/{name}"

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name))
        return self._read(df.schema, name)

    def _read(self, schema: StructType | str, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self._path(n) for n in names])

    def _levels(self) -> list[tuple[int, int]]:
        """(rank, batches up to its last) of every array, the largest first."""
        ranks = [r for r in range(self.batches.bit_length() - 1, -1, -1) if self.batches >> r & 1]
        return [(r, self.batches >> r << r) for r in ranks]

    def _array(self, rows: DataFrame, rank: int, upto: int) -> DataFrame:
        ordered = rows.repartitionByRange("run", "stretch").sortWithinPartitions("run", "stretch")
        return self._write(ordered, f"level-{rank}-{upto}")

    def add(self, texts: DataFrame) -> DataFrame:
        """Index a batch of rows (row, text); the runs that begin more than one suffix, one of them in this batch.

        Numbers of rows must differ between batches.  A null or short text has no suffixes; an empty batch counts as one.
        """
        found = written(sampled(texts, self.length, self.gram), "anchors")
        hits = self.add_suffixes(found)
        discard(found)
        return hits

    def add_suffixes(self, found: DataFrame) -> DataFrame:
        """``add`` for suffixes that ``sampled`` has listed.  The batch alone is scanned against the arrays."""
        n = self.batches + 1
        own = self._array(found.where("times > 0").select(*_SUFFIX), 0, n)
        self._write(found.where("times <> 1").select("row", "low", "wide"), f"sure-{n}")
        # An array is sorted, so that nearly all repeats of a run go before the shuffle.  Runs of the batch are shuffled once for all arrays.
        hits = own.groupBy("run").agg(F.sum("times").alias("times"))
        if self.batches:
            older = self._read(own.schema, *["level-%d-%d" % level for level in self._levels()])
            hits = hits.join(older.select("run").distinct().withColumn("met", F.lit(True)), "run", "left").where("times > 1 or met")
        else:
            hits = hits.where("times > 1")
        hits = self._write(hits.select("run"), f"hits-{n}")
        equal = []  # the levels that the batch fills up, which merge at once
        for before, upto in reversed(self._levels()):
            if before != len(equal):
                break
            equal.append(f"level-{before}-{upto}")
        if equal:
            older = self._read(own.schema, *equal)
            self._array(older.unionAll(own), len(equal), n)
            discard(older, own)
        self.batches = n
        return hits

    def suffixes(self) -> DataFrame:
        """The suffixes of all arrays."""
        return self._read(_SUFFIXES, *["level-%d-%d" % level for level in self._levels()])

    def matched(self) -> DataFrame:
        """The suffixes that share their run with another one, met in whatever batch."""
        hits = self._read("run bigint", *[f"hits-{n + 1}" for n in range(self.batches)]).distinct()
        return self.suffixes().join(hits, "run")

    def sure(self) -> DataFrame:
        """(row, low, wide) of the stretches that the tasks saw repeated."""
        return self._read("row bigint, low bigint, wide smallint", *[f"sure-{n + 1}" for n in range(self.batches)])

    def close(self) -> None:
        """Delete all files."""
        discard(self.suffixes(), *[self._read("run bigint", f"hits-{n + 1}") for n in range(self.batches)],
                *[self._read("row bigint", f"sure-{n + 1}") for n in range(self.batches)])

    def spans(self, texts: DataFrame) -> DataFrame:
        """(row, spans): of every row (row, text) with repeated bytes the stretches to remove, which may overlap.

        ``texts`` has the rows of all batches.
        """
        matched = written(self.matched(), "matched")
        out = _resolved(texts, matched, self.sure(), self.length)
        discard(matched)
        return out


def _with_text(texts: DataFrame, side: DataFrame) -> DataFrame:
    """``texts`` joined with ``side``, which has one line for a row, by row; the texts are only shuffled where there is one."""
    if side.count() <= SENT:
        texts = texts.join(F.broadcast(side.select("row")), "row", "left_semi")
    return texts.join(side, "row")


def spans(texts: DataFrame, length: int = 400, gram: int = 200, batches: int = 4) -> DataFrame:
    """(row, spans): of every row (row, text) with repeated bytes the stretches to remove, which may overlap."""
    index = written(sampled(texts, length, gram), "anchors")
    family = Family(texts.sparkSession, length=length, gram=gram)
    for b in range(batches):
        family.add_suffixes(index.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b))
    discard(index)
    matched, sure = written(family.matched(), "matched"), written(family.sure(), "sure")
    family.close()
    out = _resolved(texts, matched, sure, length)
    discard(matched, sure)
    return out


def _told_apart(suffixes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of suffixes by run and stretch: those of stretches that occur again, and one of each other stretch whose run has several of which one
    occurs only once.  The last table is to be discarded after both."""
    one = F.struct("row", "low", "back", "wide")
    variants = written(suffixes.groupBy("run", "stretch").agg(F.sum("times").alias("times"), F.min(one).alias("one")), "variants")
    whole = suffixes.join(variants.where("times > 1").select("run", "stretch"), ["run", "stretch"]).select("row", "low", "wide", "times")
    group = variants.groupBy("run").agg(F.count("*").alias("n"), F.min("times").alias("fewest")).where("n > 1 and fewest = 1")
    open_ = variants.join(group.select("run"), "run").select("one.*", F.least("times", F.lit(2)).cast("tinyint").alias("times"))
    return whole, open_, variants


def _parts(texts: DataFrame, stretches: DataFrame, length: int, make: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """What ``make`` returns for the stretches (row, low, back, wide, times) of the rows (row, text).

    ``make`` takes prefix sums and inverse powers of some text, where it begins, and low, back, wide and times of stretches in it; it
    returns the columns of ``schema`` after the row, and first the number of lines for each stretch.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = buffer(batch.column("text").slice(i, 1))
                part = batch.column("parts").slice(i, 1).flatten()
                low, back, wide, times = (part.field(c).to_numpy().astype(np.int64) for c in ("low", "back", "wide", "times"))
                order = np.argsort(low, kind="stable")
                b = 0
                while b < len(order):  # neighbouring stretches, hashed in pieces of bounded size
                    origin = low[order[b]]
                    own = order[b:b + max(1, int(np.searchsorted(low[order[b:]], origin + (1 << 20), "left")))]
                    sums, down = rolled(data[origin:origin + (1 << 20) + 3 * length])
                    columns = make(sums, down, origin, low[own], back[own], wide[own], times[own])
                    row = pa.array(np.full(len(columns[0]), batch.column("row")[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([row, *columns], names=names)
                    b += len(own)

    by_row = stretches.groupBy("row").agg(F.collect_list(F.struct("low", "back", "wide", "times")).alias("parts"))
    return _with_text(texts, by_row).mapInArrow(run, schema)


def _resolved(texts: DataFrame, matched: DataFrame, sure: DataFrame, length: int) -> DataFrame:
    """The repeated stretches among suffixes that share a run, compared exactly, and the sure ones.  ``matched`` is written."""
    step = min(PIECE, length)

    def cut(sums, down, origin, low, back, wide, times):
        """Pieces with the starts that lie k * step to k * step + step - 1 bytes before the anchor; their run is what all these strings share."""
        first, last = (back - wide) // step, back // step
        n = last - first + 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        anchor = np.repeat(low + back, n)
        far = np.minimum(k * step + step - 1, np.repeat(back, n))
        near = np.maximum(k * step, np.repeat(back - wide, n))
        at = anchor - origin
        run = mix(hashes(sums, down, at - k * step, at - k * step - step + 1 + length) + k.astype(np.uint64))
        stretch = mix(hashes(sums, down, at - far, at - near + length) + (far * 1024 + far - near).astype(np.uint64))
        return [pa.array(anchor - far), pa.array(far.astype(np.int16)), pa.array((far - near).astype(np.int16)),
                pa.array(np.repeat(times, n).astype(np.int8)), pa.array(run.view(np.int64)), pa.array(stretch.view(np.int64))]

    def strings(sums, down, origin, low, back, wide, times):
        n = wide + 1
        first = np.cumsum(n) - n
        start = np.arange(n.sum()) + np.repeat(low - origin - first, n)
        h = hashes(sums, down, start, start + length).view(np.int64)
        return [pa.array(low), pa.array(times == 1), pa.ListArray.from_arrays(pa.array(np.append(first, n.sum()).astype(np.int32)), pa.array(h))]

    # Stretches that differ although they share a run, then their pieces, then the strings of these.
    whole, open_, variants = _told_apart(matched)
    open_ = written(open_, "open")
    pieces_ = written(_parts(texts, open_, length, cut, "row bigint, low bigint, back smallint, wide smallint, times tinyint, run bigint, stretch bigint"), "pieces")
    discard(open_)
    some_whole, open_, some_variants = _told_apart(pieces_)
    open_ = written(open_, "open")
    some = written(_parts(texts, open_, length, strings, "row bigint, low bigint, single boolean, strings array<bigint>"), "strings")
    discard(open_)

    each = some.select("row", "low", "single", F.posexplode("strings").alias("i", "string"))
    again = each.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    partly = each.where("single").join(again, "string").select(
        "row", (F.col("low") + F.col("i")).alias("start"), (F.col("low") + F.col("i") + length).alias("end"))
    kept = sure.unionAll(whole.drop("times")).unionAll(some_whole.where("times = 1").drop("times"))
    found = kept.select("row", F.col("low").alias("start"), (F.col("low") + F.col("wide") + length).alias("end")).unionAll(partly)
    out = written(found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(variants, pieces_, some_variants, some)
    return out


def remove(docs: DataFrame, text: str = "text", length: int = 400, gram: int = 200, batches: int = 4,
           whole_characters: bool = False, least_words: int = 0) -> DataFrame:
    """All rows with n_bytes, removed (the maximal runs of removed bytes) and kept (the other bytes, joined).

    A byte goes if a string of ``length`` bytes that covers it starts at another place too, of the same text or another; strings are
    judged on the input and none crosses texts.  With ``whole_characters`` a character of which a byte stays, stays; maximal
    runs with fewer than ``least_words`` words, cut ones included, stay too.  A null text is empty; a text shorter than ``length`` keeps all.
    Repeated rows repeat each other's text.  Columns of these names are replaced.
    """
    added = ("n_bytes", "removed", "kept")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added or c == text], F.monotonically_increasing_id().alias("__row"))
    texts = rows.select(F.col("__row").alias("row"), F.col(f"`{text}`").alias("text"))
    found = spans(texts, length, gram, batches)
    kind = "array<struct<start:bigint,end:bigint>>"

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            removed, kept = [], []
            for i in range(batch.num_rows):
                data, _ = buffer(batch.column("text").slice(i, 1))
                span = batch.column("spans").slice(i, 1).flatten()
                start, end = span.field("start").to_numpy(), span.field("end").to_numpy()
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.append(True, start[1:] > end[:-1])
                start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
                if whole_characters:
                    inner = np.append(data & 0xC0 == 0x80, False)
                    while inner[start].any():
                        start = start + inner[start]
                    while inner[end].any():
                        end = end - inner[end]
                    start, end = start[start < end], end[start < end]
                if least_words:
                    begins = np.append(~_SPACE[data[:1]], ~_SPACE[data[1:]] & _SPACE[data[:-1]])
                    count = np.append(0, np.cumsum(begins))
                    n_words = count[end] - count[start] + (~_SPACE[data[start]] & ~begins[start])
                    start, end = start[n_words >= least_words], end[n_words >= least_words]
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
                gone = np.zeros(len(data) + 1, np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, end, -1)
                kept.append(data[np.cumsum(gone[:-1]) == 0].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary())], names=["row", "removed", "kept"])

    hit = _with_text(texts, found).select("row", "text", "spans").mapInArrow(cut, f"row bigint, removed {kind}, kept binary")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes")
    others = [F.col(f"`{c}`") for c in keep]
    if found.count() <= SENT:
        clean = rows.join(F.broadcast(found.select(F.col("row").alias("__row"))), "__row", "left_anti").select(
            *others, size, F.array().cast(kind).alias("removed"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("kept"))
        touched = rows.join(F.broadcast(found.select(F.col("row").alias("__row"))), "__row", "left_semi").join(
            hit, F.col("__row") == F.col("row")).select(*others, size, "removed", "kept")
        return clean.unionAll(touched)
    return rows.join(hit, F.col("__row") == F.col("row"), "left").select(
        *others, size, F.coalesce("removed", F.array().cast(kind)).alias("removed"),
        F.coalesce("kept", F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("kept"))
