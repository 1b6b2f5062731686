"""Reading folders as streams, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from pulsegrid.session import new_path


def stream_parquet(spark: SparkSession, path: str, schema: str, only: str | None = None,
                   files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_text(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def run_available(stream: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over all files present and return what it wrote.

    Sink and checkpoint live in the shared folder, so a lost executor costs a
    retry and a restarted stream goes on where it stopped.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, f"{label}-out"), new_path(spark, f"{label}-state")
    _run(stream, out, state, mode)
    return spark.read.schema(stream.schema).parquet(out)


def _start(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Run a stream over what is there, with the state store that ordered streams need; the session's own setting stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    query.awaitTermination()


def _run(stream: DataFrame, out: str, state: str, mode: str) -> None:
    _start(stream.sparkSession, stream.writeStream.format("parquet").outputMode(mode).option("path", out)
           .option("checkpointLocation", state))


def _closing(spark: SparkSession, schema: StructType, time: str) -> DataFrame:
    """A row at the end of what pandas can hold as a time, which moves the watermark past all others; it never comes out itself."""
    return spark.range(1).select(*[
        (F.lit("2262-01-01") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def run_closed(rows: DataFrame, make: Callable[[DataFrame], DataFrame], label: str = "stream", time: str = "ts") -> DataFrame:
    """Run ``make`` of a stream of rows that has ended, and return all it wrote, bins that the watermark had not passed included.

    When all files are read, a closing row far in the future comes from a folder of its own and moves the watermark.
    Its own bins end after the watermark and never come out.
    """
    spark = rows.sparkSession
    late = new_path(spark, f"{label}-closing")
    closing = _closing(spark, rows.schema, time)
    closing.limit(0).write.parquet(late)
    stream = make(rows.unionByName(spark.readStream.schema(rows.schema).parquet(late)))
    out, state = new_path(spark, f"{label}-out"), new_path(spark, f"{label}-state")
    _run(stream, out, state, "append")
    closing.write.mode("append").parquet(late)
    _run(stream, out, state, "append")
    return spark.read.schema(stream.schema).parquet(out)


def run_in_turn(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], label: str = "stream", time: str = "ts") -> DataFrame:
    """Run ``make`` of a stream that gets ``parts`` one after another and then ends, and return all it wrote.

    The stream stops after each part and goes on from its checkpoint with the next; a closing row ends it.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    given, out, state = (new_path(spark, f"{label}-{x}") for x in ("in", "out", "state"))
    stream = None
    for part in [*parts, _closing(spark, schema, time)]:
        part.write.mode("append").parquet(given)
        stream = make(spark.readStream.schema(schema).parquet(given)) if stream is None else stream
        _run(stream, out, state, "append")
    return spark.read.schema(stream.schema).parquet(out)


def run_each_batch(stream: DataFrame, each: Callable[[DataFrame, int], None], label: str = "stream") -> None:
    """Run a stream over all files present, one function call per micro-batch."""
    state = new_path(stream.sparkSession, f"{label}-state")
    _start(stream.sparkSession, stream.writeStream.foreachBatch(each).option("checkpointLocation", state))
