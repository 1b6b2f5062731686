"""Tables that are written for the next step."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid import session


def test_python_gets_a_bounded_number_of_bytes_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    rows = spark.range(9000, numPartitions=1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    seen = rows.mapInArrow(sizes, "rows long, bytes long")
    before = spark.conf.get(session.ARROW_BYTES, None)
    try:
        for said, most in ((None, session.AT_ONCE), ("1m", 1 << 20)):  # what the session says holds
            spark.conf.unset(session.ARROW_BYTES) if said is None else spark.conf.set(session.ARROW_BYTES, said)
            got = session.written(seen).agg(F.sum("rows"), F.max("bytes")).first()
            assert got[0] == 9000 and got[1] < most + (1 << 16)
            assert spark.conf.get(session.ARROW_BYTES) == (said or str(session.AT_ONCE))
    finally:
        spark.conf.unset(session.ARROW_BYTES) if before is None else spark.conf.set(session.ARROW_BYTES, before)
