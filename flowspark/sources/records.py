"""Sequences, reports, ledgers and evidence on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ordered import ordered
from flowspark.schemas import LEDGER_BLOCK, SEQUENCE


def read_sequence_json(spark: SparkSession, path: str) -> DataFrame:
    """Flows of every document in order: ``file``, ``seq``, endpoints, timestamp, features."""
    docs = spark.read.schema(SEQUENCE).option("multiLine", True).json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("flows").alias("seq", "_f"))
    return rows.select("file", F.col("seq").cast("bigint").alias("seq"), "_f.*")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger blocks from JSON lines; the timestamp keeps its exact number text."""
    return spark.read.schema(LEDGER_BLOCK).json(path)


def read_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a ledger with ``file`` and ``line``, in the order they were written.

    A line that is no block keeps its place, with nulls, so that verification names it.
    """
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.text(path).select("value", *place).withColumn("_in_split", F.monotonically_increasing_id())
    rows = ordered(lines, ["file"], ["_block", "_in_split"]).running(line=("sum", F.lit(1).cast("bigint"))).done()
    return rows.select(F.from_json("value", LEDGER_BLOCK).alias("_b"), "file", "line").select("_b.*", "file", "line")


def write_ledger(blocks: DataFrame, path: str) -> None:
    """One ledger in ascending order, file by file and line by line."""
    columns = [c for c in LEDGER_BLOCK.names if c in blocks.columns]
    blocks.select(columns).repartitionByRange("block_index").sortWithinPartitions("block_index").write.mode("errorifexists").json(path)


def append_ledger(blocks: DataFrame, path: str) -> None:
    blocks.select(*[c for c in LEDGER_BLOCK.names if c in blocks.columns]).write.mode("append").json(path)


def write_evidence(packets: DataFrame, path: str) -> None:
    """Evidence packets sorted by alert inside 256 digest buckets.

    One directory per alert would mean as many files as alerts; sorted buckets let a reader
    of one alert skip to its rows instead.
    """
    bucket = F.substring(F.sha2("alert_id", 256), 1, 2)
    placed = packets.withColumn("alert_bucket", bucket).repartitionByRange("alert_bucket", "alert_id", "ts_us")
    placed.sortWithinPartitions("alert_bucket", "alert_id", "ts_us", "seq").write.mode("errorifexists").partitionBy(
        "alert_bucket"
    ).parquet(path)


def read_evidence(spark: SparkSession, path: str, schema, alert_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    if alert_id is None:
        return rows
    return rows.where((F.col("alert_bucket") == F.substring(F.sha2(F.lit(alert_id), 256), 1, 2)) & (F.col("alert_id") == alert_id))
