"""Event-time replay: rows of a micro-batch wait in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowspark.streaming.source import HEARTBEAT

#: Keys are dealt to so many buckets per shuffle partition; a bucket is handled at a time, by array operations.
BUCKETS = 2


def bucket(spark: SparkSession, *keys: str, buckets: int | None = None) -> Column:
    """The bucket of a key; the number of buckets must stay the same when a query goes on from its progress."""
    buckets = buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Replay(StatefulProcessor):
    """Hands the rows of a bucket to ``advance`` in event time, whatever order they came in.

    A row is released once the watermark is ``delay_us`` or more past its ``time`` column, by an
    event-time timer; no row that comes later can belong before it.  What ``advance`` wants to keep is
    kept as one table, and a bucket without waiting rows and kept table holds no state.
    """

    def __init__(self, time: str, delay_us: int = 0):
        self.time, self.delay_us = time, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")
        self.due = handle.getValueState("due", "ms bigint")

    def close(self) -> None:
        pass

    def advance(self, released: pd.DataFrame, kept: pd.DataFrame | None, until_us: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        """Output rows, the table to keep, and the event time at which to be called again without new rows."""
        raise NotImplementedError

    def _wake(self, at_ms: int) -> None:
        now = self.due.get() if self.due.exists() else None
        if now is None or at_ms < now[0]:
            self.handle.registerTimer(at_ms)
            self.due.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        if "protocol" in frame:
            frame = frame[frame["protocol"] != HEARTBEAT]
        if len(frame):
            frame = frame.drop(columns=[c for c in ("ts", "bucket", "ended_ts") if c in frame])
            self.waiting.appendValue((pack(frame),))
            self._wake(_ms(int(frame[self.time].min()) + self.delay_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        due = self.due.get() if self.due.exists() else None
        if due is None or due[0] > now_ms:  # an earlier timer has done the work
            return
        until = now_ms * 1000 - self.delay_us
        parts = [unpack(bytes(x[0])) for x in self.waiting.get()] if self.waiting.exists() else []
        frame = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        ready = frame[self.time] <= until if len(frame) else None
        kept = unpack(bytes(self.kept.get()[0])) if self.kept.exists() else None
        out, kept, again = self.advance(frame[ready] if ready is not None else frame, kept, until)
        left = frame[~ready] if ready is not None else frame
        if len(left):
            self.waiting.put([(pack(left),)])
        else:
            self.waiting.clear()
        if kept is not None and len(kept):
            self.kept.update((pack(kept),))
        else:
            self.kept.clear()
        self.due.clear()
        times = [_ms(int(left[self.time].min()) + self.delay_us)] if len(left) else []
        times += [_ms(again)] if again is not None else []
        if times:
            self._wake(min(times))
        if out is not None and len(out):
            yield out


def _ms(us: int) -> int:
    return -(-us // 1000)


def replayed(rows: DataFrame, processor: Replay, schema: str, event_time: str | None = None) -> DataFrame:
    """``processor`` over a stream with a ``bucket`` column and a watermark."""
    named = {"eventTimeColumnName": event_time} if event_time else {}
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", **named)
