"""Rows of a stream in event-time order, key by key.

Rows wait in list state until the watermark has passed them, in chunks as they came; then those that are due go through
a ``Step`` in the order (ts, seq), whatever files and micro-batches they came in.  An event-time timer stands at the
earliest waiting row or at the time a step asked for, so quiet keys move on too.  A row that comes after the watermark
passed it is dropped by Spark; until then none is late.  Watermarks start at 1970, so rows up to then count as late, and
times end at 2262, where pandas does.  What waits of a key is what comes within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.schema import micros


class Step:
    """What happens to the rows of one key.  State is a tuple of the columns ``state``, output rows have those of ``out``."""

    state: str
    out: str

    def begin(self) -> tuple:
        """State of a key that has none."""
        raise NotImplementedError

    def rows(self, key: tuple, state: tuple, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame | None]:
        """Take the next rows, in order; ``us`` is their time in microseconds."""
        raise NotImplementedError

    def until(self, key: tuple, state: tuple, now: int) -> tuple[tuple | None, pd.DataFrame | None]:
        """All rows up to ``now`` have gone in; a state of None is deleted."""
        return state, None

    def wake(self, state: tuple) -> int | None:
        """When ``until`` must be called even if no row comes."""
        return None


class _InOrder(StatefulProcessor):
    def __init__(self, step: Step, schema: pa.Schema):
        self.step, self.schema = step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first bigint, rows binary")
        self.known = handle.getValueState("known", self.step.state)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendValue(self._chunk(pa.Table.from_pandas(frame, self.schema, preserve_index=False)))
            first = int(frame["us"].min()) if first is None else min(first, int(frame["us"].min()))
        if first is not None:
            self._wake_by(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        kept, due = [], []
        for first, chunk in self.waiting.get():
            if first > now:
                kept.append((first, bytes(chunk)))
            else:
                due.append(pa.ipc.open_stream(bytes(chunk)).read_all())
        state = self.known.get() if self.known.exists() else self.step.begin()
        outs = []
        if due:
            table = pa.concat_tables(due).sort_by([("us", "ascending"), ("seq", "ascending")])
            ready = int(pa.compute.sum(pa.compute.less_equal(table["us"], now)).as_py() or 0)
            if ready:
                state, out = self.step.rows(key, state, table.slice(0, ready).to_pandas())
                outs.append(out)
            if ready < table.num_rows:
                kept.append(self._chunk(table.slice(ready)))
            if kept:
                self.waiting.put(kept)
            else:
                self.waiting.clear()
        state, out = self.step.until(key, state, now)
        outs.append(out)
        if state is None:
            self.known.clear()
        else:
            self.known.update(state)
        times = [first for first, _ in kept]
        if state is not None and (at := self.step.wake(state)) is not None:
            times.append(max(at, now + 1000))
        if times:
            self._wake_by(min(times))
        yield from (out for out in outs if out is not None and len(out))

    def close(self) -> None:
        pass

    def _wake_by(self, us: int) -> None:
        """Move the timer of the key to ``us`` if that is earlier."""
        ms = -(-us // 1000)
        if self.timer.exists():
            (at,) = self.timer.get()
            if at <= ms:
                return
            self.handle.deleteTimer(at)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    @staticmethod
    def _chunk(table: pa.Table) -> tuple[int, bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return int(pa.compute.min(table["us"]).as_py()), sink.getvalue().to_pybytes()


def in_order(rows: DataFrame, key: str, step: Step, watermark: str) -> DataFrame:
    """Run ``step`` over the rows of every ``key`` in the order of ``(ts, seq)``; rows without a time are dropped.

    Needs the RocksDB state store, which ``run_available`` and its siblings and ``build_session`` set.
    """
    rows = rows.filter("ts is not null").withColumn("us", micros(F.col("ts"))).withWatermark("ts", watermark)
    rest = to_arrow_schema(rows.drop("ts").schema)
    given = rows.select("ts", *[F.col(f"`{c}`") for c in rest.names])
    return given.groupBy(key).transformWithStateInPandas(_InOrder(step, rest), step.out, "append", "EventTime")
