"""Streaming packet sources, heartbeats and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.schemas import PACKET
from flowspark.session import fresh_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEARTBEAT = "heartbeat"


def stream_packets(
    spark: SparkSession, path: str, schema: StructType = PACKET, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """Landed files as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def with_event_time(stream: DataFrame, delay_us: int, column: str = "ts_us") -> DataFrame:
    """Add ``ts`` and hold results back by ``delay_us`` behind the latest event."""
    return stream.withColumn("ts", F.timestamp_micros(column)).withWatermark("ts", f"{delay_us} microseconds")


def heartbeat(spark: SparkSession, ts_us: int, schema: StructType = PACKET) -> DataFrame:
    """One row that only moves event time: idle ticks and end of input need it, because a
    watermark advances with data alone.  It carries its own protocol and joins no flow."""
    values = {"ts_us": ts_us, "seq": -1, "protocol": HEARTBEAT}
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful Python operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run all available input to the end into a new table and return it."""
    spark = stream.sparkSession
    out = fresh_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], progress: str, mode: str = "append") -> StreamingQuery:
    """Feed every micro-batch to ``sink(frame, batch_id)``; replays repeat the batch id."""
    return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped behind the watermark so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def split_late(packets: DataFrame, delay_us: int, limit: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Rows on time, and rows behind the watermark at their arrival with ``lateness_us``."""
    rows = ordered(packets, [], ["seq"], limit).running(_latest=("max", "ts_us")).done()
    behind = F.col("_latest") - delay_us - F.col("ts_us")
    on_time = rows.where(behind <= 0).drop("_latest")
    return on_time, rows.where(behind > 0).withColumn("lateness_us", behind).drop("_latest")
