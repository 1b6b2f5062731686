"""Large JSON arrays, each split over many tasks.

The text is read as records that end at ``}``, so Spark cuts a file where it likes.  Whether a place is inside a string, and how deep
the brackets are there, are prefix sums: inside the blocks of a file by windows, and over a table of one row per block.  Every ``}`` that
leads back to depth 1 ends an entry; the records of an entry, which may begin in the block before, are then joined by its number.  Blocks are what
Spark reads at once, cut at every ``BLOCK_RECORDS`` records, and are dealt to as many tasks as the text has pieces of ``TASK_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.session import written


#: Most records of a block, and bytes of text that a task gets, about; both bound what it sorts.
BLOCK_RECORDS = 1 << 14
TASK_BYTES = 8 << 20

_BLOCK = ["file", "block", "piece"]


def _tasks(spark: SparkSession, path: str | list[str]) -> int:
    """Partitions of the shuffles of the text; a fixed number, as partitions joined by their compressed size would hold too much."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def _depth_change(plain: Column, inside: int) -> Column:
    """Brackets opened less those closed by a record without escapes and the ``}`` after it, if it begins inside a string or not."""
    outside = F.regexp_replace(F.concat(F.lit('"' * inside), plain), r'"[^"]*("|$)', "")
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    closed = F.length(outside) - F.length(F.translate(outside, "]", ""))
    return opened - closed - F.when((_quotes(plain) + inside) % 2 == 0, 1).otherwise(0)


def _quotes(plain: Column) -> Column:
    return F.length(plain) - F.length(F.translate(plain, '"', ""))


def _records(spark: SparkSession, path: str | list[str], tasks: int) -> DataFrame:
    """(file, size, block, piece, k, value, quotes, odd, d0, d1): odd counts the quotes of the block before, d0 and d1 are depth changes
    if the block begins outside or inside a string."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("k"), "value")
    text = text.withColumn("piece", F.floor(F.col("k") / BLOCK_RECORDS)).repartition(tasks, *_BLOCK)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    before = Window.partitionBy(*_BLOCK).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = text.select("*", _quotes(plain).alias("quotes"), _depth_change(plain, 0).alias("out"), _depth_change(plain, 1).alias("in"))
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    even = F.col("odd") == 0
    return rows.select("file", "size", "block", "piece", "k", "value", "quotes", "odd",
                       F.when(even, F.col("out")).otherwise(F.col("in")).alias("d0"),
                       F.when(even, F.col("in")).otherwise(F.col("out")).alias("d1"))


def _block_starts(records: DataFrame) -> DataFrame:
    """(file, block, piece, inside, depth, reason) at the start of every block; the reason why its file is no JSON array."""
    blocks = records.groupBy("file", "size", "block", "piece").agg(
        F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.count("*").alias("n"),
        F.sum(F.octet_length("value")).alias("bytes"), F.min_by(F.regexp_extract("value", r"^\s*(.)", 1), "k").alias("opening"))
    file = Window.partitionBy("file")
    before = file.orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("change", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    # The last record has no bracket after it, though one was counted; where the file ends with one, the bytes tell.
    whole = ((F.sum("change").over(file) == -1) & (F.sum("quotes").over(file) % 2 == 0)
             & (F.sum("bytes").over(file) + F.sum("n").over(file) - 1 == F.col("size")))
    reason = F.when(F.min_by("opening", F.struct("block", "piece")).over(file) != "[", "not a list").when(~whole, "not a JSON document")
    return blocks.select("file", "block", "piece", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), reason.alias("reason"))


def array_entries(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, e) of every object in the JSON arrays that the files are, parsed by ``schema``.

    A file takes as many tasks as it has blocks, and no more than an entry is held at once.  Elements that are no objects are left out.  A
    file that is no array or not JSON stops the read (what follows the last entry is checked for brackets and quotes only); an empty one
    has no entries.  Repeated entries all count.
    """
    tasks = _tasks(spark, path)
    records = _records(spark, path, tasks)
    starts = _block_starts(records)
    sound = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "file", "reason")).cast("boolean"))
    block = Window.partitionBy(*_BLOCK).orderBy("k")
    change = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    depth = F.col("depth") + F.sum(change).over(block)
    outside = (F.col("odd") + F.col("inside") + F.col("quotes")) % 2 == 0
    marked = written(records.join(starts.filter(sound), _BLOCK).select(
        *_BLOCK, "k", "value", F.when(outside & (depth == 1), 1).otherwise(0).alias("ends")), "json")

    earlier = Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ended = marked.groupBy(*_BLOCK).agg(F.sum("ends").alias("ended")).select(
        *_BLOCK, F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.coalesce(F.sum("ends").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = marked.repartition(tasks, *_BLOCK).join(ended, _BLOCK).select("file", number.alias("number"), "ends", F.struct("block", "k", "value").alias("part"))
    # What follows the last entry of a file ends nowhere and holds no object.
    entries = parts.repartition(tasks, "file", "number").groupBy("file", "number").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list("part")).alias("parts")).filter("ends = 1")
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    begins = F.when(F.col("number") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    elements = F.from_json(F.concat(F.lit("["), begins, F.lit("]")), "array<string>")
    # The last element is the entry, unless the text is cut by a bracket that ends the array too early.
    element = F.try_element_at(elements, F.lit(-1))
    # Filters may be evaluated in any order, so what stands after the last entry must not fail here either.
    failed = F.raise_error(F.concat("file", F.lit(": not a JSON document"))).cast("string")
    apart = (F.col("number") == 0) | text.rlike(r"^\s*,")
    element = F.when(apart & F.endswith(element, F.lit("}")), element).when(F.col("ends") == 1, failed)
    return entries.select("file", F.from_json(element, schema).alias("e"))
