"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. A document becomes its set of 64-bit shingle hashes.  Equal sets are one class, which has a number of its own and is read again from
   a text of its smallest id.  Classes are the nodes of all that follows; ids come back only with the result.
2. Similar classes are put into groups: classes that share a least shingle under one of a few random orders are compared with
   the smallest of them, and the links found make components, cut into groups of about ``group`` classes.
3. The token-group matrix holds, for every group, the tokens that can prove a link, which are the first tokens of its members in one
   order of all tokens (of two sets that overlap enough, each has one of the other's among its first n - need + 1).  The order puts
   tokens that many documents share last; any order gives the same links.  A class meets the groups of other components through these
   tokens, if a member of the group has a size that can match.
4. A group is stored with a bitmap of its token union, which bounds the overlap of a class with any of its members.  Only groups that
   can hold a partner are opened: then their members' own bitmaps are read, and members that can be partners are compared, set with set.

Only components are asked for, so classes that are connected already are not compared again, and a group of near copies costs about as
many comparisons as it has members.  What is counted, joined or summed by a token, a least shingle, a class or a component goes
through partial sums and joins that split hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.graph import components
from pulsegrid.llm.texts import chunks, mix, shingle_sets
from pulsegrid.session import discard, written

#: Random orders for step 2.
ORDERS = 4
#: Tokens counted together in a task, and how often one must occur there to count as frequent.
COUNTED, OFTEN = 1 << 20, 8
#: Ids that are sent to the tasks that read texts; beyond it the texts are joined by a shuffle.
SENT = 1 << 20
#: Bytes of text that a task cuts into shingles at once.
PIECE = 1 << 18


def _need(n: np.ndarray | int, part: int, whole: int):
    """The least overlap with any set that a set of ``n`` must have for a Jaccard similarity of ``part`` / ``whole``."""
    return -(-part * n // whole)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of the hashed tokens, four to eight times as many as there are tokens, a power of two."""
    m = 4 << max(4, int(len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(m, bool)
    bits[((tokens >> np.uint64(24)) & np.uint64(m - 1)).astype(np.int64)] = True
    return bits


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _folded(bits: np.ndarray, m: int) -> np.ndarray:
    return bits.reshape(-1, m).any(0)


def most_common(n: int, bits: np.ndarray, other: np.ndarray) -> int:
    """A bound on the tokens that a set of ``n`` with ``bits`` shares with a set or union with the bits ``other``."""
    m = min(len(bits), len(other))
    a, b = _folded(bits, m), _folded(other, m)
    return int((a & b).sum()) + n - int(a.sum())


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id}`").cast("long").alias("__id"), text_hash(text).alias("__h"), F.col(f"`{text}`").alias("__text"))


def sets(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """For each row: id, hash of the text, n, a 128-bit fingerprint, the least token in each order, bits.  Rows with a ``token`` count
    frequent tokens instead."""
    schema = ("doc bigint, h bigint, n bigint, f1 bigint, f2 bigint, least array<bigint>, bits binary, token bigint, times bigint")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times >= OFTEN].view(np.int64), times[times >= OFTEN]
            none = pa.nulls(len(token))
            return pa.RecordBatch.from_arrays(
                [none.cast(pa.int64())] * 5 + [none.cast(pa.list_(pa.int64())), none.cast(pa.binary()), pa.array(token), pa.array(times)], names=names)

        for batch in chunks(batches, "__text", PIECE):
            found = shingle_sets(batch.column("__text"), width)
            n = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            full = n > 0
            at = (np.cumsum(n) - n)[full]

            def each(ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(n), np.uint64)
                if len(at):
                    out[full] = ufunc.reduceat(values, at)
                return out

            f1 = mix(each(np.add, mix(flat)) + n.astype(np.uint64))
            f2 = mix(each(np.add, mix(flat * np.uint64(0xD6E8FEB86659FD93))))
            least = np.stack([each(np.minimum, mix(flat ^ np.uint64(0xA0761D6478BD642F * (r + 1) % (1 << 64)))) for r in range(ORDERS)], axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("__id"), batch.column("__h"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                pa.array(list(least.view(np.int64)), pa.list_(pa.int64())),
                pa.array([np.packbits(bitmap(x)).tobytes() for x in found], pa.binary()),
                pa.nulls(len(n)).cast(pa.int64()), pa.nulls(len(n)).cast(pa.int64())], names=names)
            for f, x in zip(f1.tolist(), found):
                if f not in seen:
                    seen.add(f)
                    held.append(x)
                    size += len(x)
            if size > COUNTED:
                yield frequent()
                held, size = [], 0
                seen.clear()
        if held:
            yield frequent()

    return _texts(docs, id, text).mapInArrow(run, schema)


def matrix_rows(docs: DataFrame, text: str, width: int, late: np.ndarray, part: int, whole: int) -> DataFrame:
    """(token, f1, rest, late): the first tokens of every set, once for each class and task; ``late`` tokens come last in the order.

    ``rest`` counts the set's tokens from this one on: two sets whose first common token it is share no more than that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches, "__text", PIECE):
            token, owner, hot, after = [], [], [], []
            for x in shingle_sets(batch.column("__text"), width):
                if not len(x):
                    continue
                f1 = int(mix(np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x))]))[0])
                if f1 in seen:
                    continue
                seen.add(f1)
                k = len(x) - _need(len(x), part, whole) + 1
                if len(late):
                    is_late = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x
                    first = x[~is_late][:k]
                    rest = x[is_late][:k - len(first)]
                else:
                    first, rest = x[:k], x[:0]
                token += [first, rest]
                hot += [np.zeros(len(first), bool), np.ones(len(rest), bool)]
                owner.append(np.full(len(first) + len(rest), f1, np.uint64))
                after.append(len(x) - np.arange(len(first) + len(rest)))
            if len(seen) > 1 << 20:
                seen.clear()
            if token:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(owner).view(np.int64)),
                    pa.array(np.concatenate(after)), pa.array(np.concatenate(hot))], names=["token", "f1", "rest", "late"])

    return docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "token bigint, f1 bigint, rest bigint, late boolean")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The rows, without repeats, of tokens that two classes have; ``rows`` holds no frequent token."""
    names = ["token", "f1", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def of(token: np.ndarray, owner: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner, rest = token[new], owner[new], rest[new]
            twin = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            return pa.RecordBatch.from_arrays([pa.array(c[twin]) for c in (token, owner, rest)], names=names)

        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield of(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield of(*held)

    return rows.repartition("token").sortWithinPartitions("token", "f1").mapInArrow(run, "token bigint, f1 bigint, rest bigint")


def _unions(member: DataFrame) -> DataFrame:
    """(part, block, fewest, union) of the groups of ``member``: the bits of the token union, as long as the shortest of the members' bitmaps."""
    names = ["part", "block", "fewest", "union"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, union = None, None
        for batch in batches:
            done = []
            for *key, bits in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "fewest", "bits")]):
                bits = _bits(bits)
                if key != here:
                    if here:
                        done.append((*here, np.packbits(union).tobytes()))
                    here, union = key, bits
                else:
                    m = min(len(union), len(bits))
                    union = _folded(union, m) | _folded(bits, m)
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
        if here:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*here, np.packbits(union).tobytes())))], schema)

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("fewest", pa.int64()), ("union", pa.binary())])
    rows = member.select("part", "block", "fewest", "bits").repartition("part", "block").sortWithinPartitions("part", "block")
    return rows.mapInArrow(run, "part bigint, block bigint, fewest bigint, union binary")


def _sent(small: DataFrame) -> DataFrame:
    """The table, sent to all tasks if it is not too long."""
    return F.broadcast(small) if small.count() <= SENT else small


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, copies: DataFrame | None, id: str, text: str, width: int,
           part: int, whole: int) -> DataFrame:
    """Those (a, b) of ``pairs`` of classes whose sets are similar, compared token by token.

    A class is read from the text with its ``rep`` and ``h``.  ``copies`` lists the (doc, h) of several rows, which are read as one.
    """
    def read(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "__text", PIECE):
                found = shingle_sets(batch.column("__text"), width)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array([x.tobytes() for x in found], pa.binary())],
                                                 names=[*keys, "set"])
        return run

    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    few = pairs.count() <= SENT
    small = F.broadcast if few else (lambda x: x)
    place = classes.select("node", F.col("rep").alias("__id"), F.col("h").alias("__h"))
    texts, key = _texts(docs, id, text), ["__id", "__h"]

    def of(wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` with the text of their class."""
        if copies is None:
            return texts.join(small(wanted), key)
        several = _sent(copies.select(F.col("doc").alias("__id"), F.col("h").alias("__h")))
        one = (texts.join(several, key, "left_semi").join(small(wanted.select(*key).distinct()), key, "left_semi")
               .groupBy(*key).agg(F.first("__text").alias("__text")))
        return texts.join(several, key, "left_anti").unionAll(one.select(*texts.columns)).join(small(wanted), key)

    left = (of(place.join(small(pairs), F.col("node") == F.col("a")).select(*key, "a", "b")).select("a", "b", "__text")
            .mapInArrow(read(["a", "b"]), "a bigint, b bigint, set binary"))
    right = (of(place.join(small(pairs.select("b").distinct()), F.col("node") == F.col("b")).select(*key, "b")).select("b", "__text")
             .mapInArrow(read(["b"]), "b bigint, set binary").withColumnRenamed("set", "other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set"), batch.column("other")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(len(p) and len(q)) and whole * common >= part * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right.hint("shuffle_merge"), "b").select("a", "b", "set", "other").mapInArrow(compare, "a bigint, b bigint")


def _classes(docs: DataFrame, id: str, text: str, width: int, part: int, whole: int, group: int,
             late_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """Rows (doc, h, n, f1, f2), classes (f1, f2, node, rep, h), the ids and the (doc, h) of several rows if there are any, and links of nodes."""
    spark = docs.sparkSession
    summary = written(sets(docs, id, text, width), "sets")
    rows = summary.where("token is null").drop("token", "times")
    often = (summary.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
             .orderBy(F.desc("times"), "token").limit(late_tokens).select("token").toArrow())
    late = np.sort(often["token"].to_numpy().astype(np.int64).view(np.uint64))
    classes = rows.where("n > 0 and doc is not null").groupBy("f1", "f2").agg(
        F.min("doc").alias("rep"), F.min_by("h", F.struct("doc", "h")).alias("h"), F.first("n").alias("n"), F.first("least").alias("least"),
        F.first("bits").alias("bits"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    ids = written(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc"), "ids")
    copies = None
    if ids.isEmpty():
        ids = None
    else:
        copies = written(rows.join(_sent(ids), "doc").groupBy("doc", "h").agg(F.count("*").alias("c")).where("c > 1"), "copies")

    def may(n: str, m: str):
        return (F.col(n) * whole >= F.col(m) * part) & (F.col(m) * whole >= F.col(n) * part)

    # Step 2: every class with the smallest of those that share a least token, the one that shares most.
    by_least = classes.select("node", "rep", "n", "least", F.posexplode("least").alias("r", "key"))
    hubs = by_least.groupBy("r", "key").agg(F.min(F.struct("rep", "node", "n", "least")).alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = (by_least.join(hubs, ["r", "key"]).where(F.col("node") != F.col("hub.node")).withColumn("m", F.col("hub.n")).where(may("n", "m"))
            .withColumn("alike", F.aggregate(F.zip_with("least", "hub.least", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x))
            .where("alike > 1").groupBy("node").agg(F.max(F.struct("alike", F.col("hub.node").alias("b"))).alias("best"))
            .select(F.col("node").alias("a"), F.col("best.b").alias("b")))
    links = written(linked(docs, near, classes, copies, id, text, width, part, whole), "links")
    parts = written(components(links), "parts")

    member = classes.select("f1", "node", "n", "bits").join(parts, "node", "left").select(
        "f1", "node", "n", "bits", F.coalesce("component", "node").alias("part"))
    sizes = member.groupBy("part").agg(F.count("*").alias("size"))
    member = member.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / group).cast("long")))
    extent = member.groupBy("part", "block").agg(F.min("n").alias("fewest"), F.max("n").alias("most"))
    member = written(member.join(extent, ["part", "block"]), "member")

    # Step 3: a class meets the groups of larger components (by size, then id) that have one of its first tokens.
    all_rows = written(matrix_rows(docs, text, width, late, part, whole), "matrix")
    cols = ["token", "f1", "rest"]
    shared = shared_tokens(all_rows.where("not late").select(*cols)).unionAll(all_rows.where("late").select(*cols).distinct())
    shared = written(shared.join(member.select("f1", "node", "n", "part", "size", "block", "fewest", "most"), "f1").drop("f1"), "shared")
    discard(all_rows)
    rank = F.struct("size", "part")
    ends = (shared.groupBy("token").agg(F.max(rank).alias("top"), F.min(rank).alias("low")).where("low <> top").select("token", "top"))
    met = shared.join(ends, "token")
    asking = met.where(rank != F.col("top")).select("token", "node", "n", "rest", rank.alias("own"))
    matrix = met.groupBy("token", "part", "size", "block", "fewest", "most").agg(F.max("rest").alias("longest")).select(
        "token", rank.alias("theirs"), "part", "block", "fewest", "most", "longest")
    # the least overlap with any member that is large enough, against what is left from the first common token on
    smallest = F.greatest(F.col("fewest") * whole, F.col("n") * part)
    meetings = asking.join(matrix, "token").where(
        (F.col("own") < F.col("theirs")) & (F.col("n") * whole >= F.col("fewest") * part) & (F.col("most") * whole >= F.col("n") * part)
        & (F.least("rest", "longest") * whole * (whole + part) >= (F.col("n") * whole + smallest) * part)
    ).select("node", "part", "block").distinct()

    # Step 4: bound by the union's bits, open groups that can hold a partner, bound by the members' bits, compare.
    groups = written(_unions(member), "groups")
    asked = meetings.join(member.select("node", "n", "bits"), "node").join(groups, ["part", "block"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, bits, fewest, union in zip(*[batch.column(c) for c in ("n", "bits", "fewest", "union")]):
                n = n.as_py()
                least = max(fewest.as_py(), _need(n, part, whole))  # the smallest member that can be a partner
                keep.append(most_common(n, _bits(bits.as_py()), _bits(union.as_py())) >= -(-part * (n + least) // (whole + part)))
            yield batch.select(["part", "block", "node", "n", "bits"]).filter(pa.array(keep, pa.bool_()))

    qualified = asked.mapInArrow(bound, "part bigint, block bigint, node bigint, n bigint, bits binary")
    others = member.select("part", "block", F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("theirs"))
    bounded = qualified.join(others, ["part", "block"]).where(may("n", "m")).select(F.col("node").alias("a"), "b", "n", "m", "bits", "theirs")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [most_common(n, _bits(x.as_py()), _bits(y.as_py())) >= -(-part * (n + m) // (whole + part)) for n, m, x, y in zip(
                batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("bits"), batch.column("theirs"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    opened = bounded.mapInArrow(open_, "a bigint, b bigint")
    more = written(linked(docs, opened, classes, copies, id, text, width, part, whole), "links")
    discard(shared, member, parts, groups)
    return rows.select("doc", "h", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2"), classes.select("f1", "f2", "node", "rep", "h"), ids, copies, links.unionAll(more)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, part: int = 80, whole: int = 100,
         group: int = 32, late_tokens: int = 1 << 17) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the smallest id reachable by links, its own included.

    Two documents link when whole * |A and B| >= part * |A or B|.  Words are split at space and U+0009 to U+000D, A-Z count as a-z, and
    a text of fewer than ``width`` words is one shingle.  A null text or one without words has an empty set and links with nothing; a null id
    links with nothing and has a null component.  Rows that share an id count as one node.  Other columns are not read.
    ``late_tokens`` bounds the list of frequent tokens sent to the tasks, which changes the order of tokens, not the links.
    """
    rows, classes, ids, _, found = _classes(docs, id, text, width, part, whole, group, late_tokens)
    links = found
    if ids is not None:  # all classes of an id hang on one of them
        of_id = written(rows.where("n > 0").join(_sent(ids), "doc").join(classes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc", "node").distinct(), "nodes")
        least = of_id.groupBy("doc").agg(F.min("node").alias("b"))
        links = links.unionAll(of_id.withColumnRenamed("node", "a").join(least, "doc").where("a <> b").select("a", "b"))
    parts = components(links)
    discard(found)
    named = classes.select("f1", "f2", "node", "rep").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    smallest = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    reps = named.join(smallest, "part").select("f1", "f2", "node", "component_id")
    out = rows.join(reps.drop("node"), ["f1", "f2"], "left")
    if ids is not None:  # rows without words whose id has words in another row
        blank = of_id.join(reps, "node").groupBy("doc").agg(F.min("component_id").alias("id_component"))
        out = out.join(blank, "doc", "left").withColumn("component_id", F.coalesce("component_id", "id_component"))
    return out.select(F.col("doc").alias(id), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def kept(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, part: int = 80, whole: int = 100,
         group: int = 32, late_tokens: int = 1 << 17) -> DataFrame:
    """(doc, h, times): the id and ``text_hash`` of the text to keep of each group of near duplicates, and of every text without words.

    Texts are grouped by their own links only, so that unlike texts under one id stay apart.  The text with the smallest id is kept, then
    with the least hash.  ``times`` is the number of rows with them, 1 where all such rows stay.  A null id is not listed.
    """
    rows, classes, _, copies, links = _classes(docs, id, text, width, part, whole, group, late_tokens)
    parts = components(links)
    discard(links)
    named = classes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = named.groupBy("part").agg(F.min("rep").alias("doc"), F.min_by("h", F.struct("rep", "h")).alias("h")).select("doc", "h")
    if copies is None:
        first = first.withColumn("times", F.lit(1).cast("long"))
    else:
        first = first.join(copies, ["doc", "h"], "left").select("doc", "h", F.coalesce("c", F.lit(1)).alias("times"))
    blank = rows.where("n = 0 and doc is not null").select("doc", "h").distinct()
    return first.unionAll(blank.withColumn("times", F.lit(1).cast("long")))
