"""Tables, splits and row-wise scoring shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.texts import chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; a null key counts as 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % modulus


def per_text(df: DataFrame, text: str, fields: dict[str, tuple[str, pa.DataType]],
             make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Every row of ``df`` with further columns computed from its text.

    ``make`` is called once in each task and returns the function from a text column to the
    new columns.  Columns of ``df`` with a new column's name are replaced.
    """
    kept = [c for c in df.columns if c not in fields or c == text]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    final = [c for c in kept if c not in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in chunks(batches, text):
            new = score(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in final] + [a.cast(fields[f][1]) for f, a in zip(fields, new)],
                names=[*final, *fields])

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in final] + [f"`{f}` {t}" for f, (t, _) in fields.items()])
    return source.mapInArrow(run, schema)
