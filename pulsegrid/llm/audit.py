"""What a chain of document filters removes, in every order of the filters.

Filters that look at one text are columns.  Whether a text repeats is found in two steps: a counting Bloom sketch of
text hashes, kept as counts of its touched slots and merged by their sums, clears texts that are certainly unique;
only the possible repeats are shuffled, and their whole texts grouped, for the smallest id of each text.  A document
becomes a bit mask of the filters it fails, and everything reported is a sum of counts of masks, so no order is run.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import discard, written

#: Slots of the sketch: a power of two, at least SLOTS_PER_TEXT for each text and at most MOST_SLOTS, which are 128 MB as
#: bits.  Beyond that, more unique texts count as possible repeats; the result is the same.
SLOTS_PER_TEXT, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 16, 1 << 30
#: Slots that a text counts in.
HASHES = 3
#: Bits of one of Spark's bitmaps, a piece of the merged sketch.
PIECE_BITS = 1 << 15

_WORD = r"[^\x20\x09-\x0D]+"


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def _few_different(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def _capitals(text: Column, words: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return 100 * (F.length(text) - F.length(F.translate(text, capitals, ""))) > 2 * F.length(text)


def _signs(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


Rule = Callable[[Column, Column], Column]

#: Whether a text fails, from the text and its words: under 200 words, under half of the words different, over 2 % capitals, a sign.
RULES: dict[str, Rule] = {"A": _few_words, "B": _few_different, "C": _capitals, "D": _signs}


def slot_count(texts: int) -> int:
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_PER_TEXT * max(1, texts) - 1).bit_length()))


def _slots(h: Column, slots: int) -> list[Column]:
    """The places of a text in the sketch: arithmetic steps from one half of its hash by the other, odd half."""
    first, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(first + k * step).bitwiseAND(F.lit(slots - 1)) for k in range(HASHES)]


def sketch(hashes: DataFrame, slots: int) -> np.ndarray:
    """Bits of the slots that more than one row of the column ``h`` counts in, merged over all tasks."""
    touched = hashes.select(F.explode(F.array_distinct(F.array(*_slots(F.col("h"), slots)))).alias("slot"))
    crowded = touched.groupBy("slot").count().where("count > 1")
    pieces = crowded.groupBy(F.floor(F.col("slot") / PIECE_BITS).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("slot") % PIECE_BITS).alias("bits")).toArrow()
    merged = np.zeros(slots // 8, np.uint8)
    for piece, bits in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist()):
        at = merged[piece * PIECE_BITS // 8:(piece + 1) * PIECE_BITS // 8]
        at[:] = np.frombuffer(bits, np.uint8)[:len(at)]
    return merged


def maybe_repeated(h: Column, merged: np.ndarray) -> Column:
    """False only where the text of hash ``h`` is in one row."""
    slots = len(merged) * 8

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        v = values.to_numpy(np.int64, na_value=0).view(np.uint64)
        first, step = v & np.uint64(0xFFFFFFFF), (v >> np.uint64(32)) | np.uint64(1)
        crowded = np.ones(len(v), bool)
        for k in range(HASHES):
            at = (first + np.uint64(k) * step) & np.uint64(slots - 1)
            crowded &= (merged[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(crowded)

    return test(h)


def marks(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(doc_id, part, mask of the failed rules, 64-bit hash h, SHA-256 digest) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    mask = F.lit(0)
    for k, rule in enumerate(rules.values()):
        mask = mask + F.when(rule(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    return read.select("doc_id", "part", mask.cast("int").alias("mask"), F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Documents of each part and mask: n, and among them good (label quality 1) and toxic (label toxic 1) ones.

    The bit after those of the rules stands for a text that equals the text of a smaller id.  A null text is empty, a
    null source is the part "".  Rows without an id equal no smaller id and are no smaller id to others; rows that
    repeat an id and its text count each, and none of them fails for the other.  Of several label rows of an id, one
    that says 1 is enough.
    """
    marked = written(marks(docs, rules), "marks")
    merged = sketch(marked.select("h"), slot_count(marked.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    possible = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(maybe_repeated(F.xxhash64(text), merged))
    firsts = possible.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id")
    firsts = written(firsts.where("doc_id is not null").withColumn("first", F.lit(True)), "firsts")
    again = (marked.where(maybe_repeated(F.col("h"), merged)).join(firsts, ["digest", "doc_id"], "left")
             .where("first is null and doc_id is not null"))
    bit = 1 << len(rules)
    moved = F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.lit(1).alias("n"))))
    rows = marked.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionAll(
        again.select("doc_id", "part", moved.alias("m")).select("doc_id", "part", "m.mask", "m.n"))
    graded = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")).where("doc_id is not null and good + toxic > 0")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    counts = rows.join(graded, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))
    counts = written(counts.where("n > 0"), "masks")
    discard(marked, firsts)
    return counts


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, repeat: str = "E") -> DataFrame:
    """One row for each part, order of all filters and step in it, with the counts of documents described below.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are ignored.  The filters
    are ``rules`` and ``repeat``, the name of the filter on repeated texts, one letter each.  kept: left after the step;
    removed: by the step; redundant: fail its filter and went before; unique_fails: fail its filter alone; good_lost and
    toxic_lost: labelled among the removed; shapley: removed by its filter, summed over all orders.  Parts come from the
    documents: an empty table gives no rows.  Nulls, ties and repeated rows: see ``mask_counts``.
    """
    names = "".join(rules) + repeat
    size = len(names)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    parts = mask_counts(docs, labels, rules).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    number = F.explode(F.sequence(F.lit(0), F.lit(factorial(size) * size - 1)))
    rows = parts.select("part", "counts", number.alias("k")).select(
        "part", "counts", F.get(orders, F.floor(F.col("k") / size).cast("int")).alias("filter_order"), (F.col("k") % size + 1).alias("step"))

    letter = lambda place: F.substr(F.col("filter_order"), place, F.lit(1))
    bit = lambda place: F.pow(F.lit(2), F.instr(F.lit(names), letter(place)) - 1).cast("int")
    before = sum((F.when(F.col("step") > k, bit(F.lit(k))).otherwise(0) for k in range(1, size)), F.lit(0))
    rows = rows.select("*", bit(F.col("step")).alias("own"), before.alias("before"))

    def total(which: Callable[[Column], Column], of: Callable[[Column], Column] = lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("counts", which), F.lit(0).cast("long"), lambda s, c: s + of(c))

    own, before = F.col("own"), F.col("before")
    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    gone = lambda c: has(c, own) & ~has(c, before)
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda c: ~has(c, own + before)).alias("kept"), total(gone).alias("removed"),
        total(lambda c: has(c, own) & has(c, before)).alias("redundant"), total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(gone, lambda c: c["good"]).alias("good_lost"), total(gone, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: has(c, own), lambda c: c["n"] * (F.lit(factorial(size)) / F.bit_count(c["mask"])).cast("long")).alias("shapley"))
