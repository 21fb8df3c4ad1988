"""An alert feed with every alert once, however often a micro-batch is delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowspark.operators.ordered import ordered

COMMIT = "batch_id bigint, alerts bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, alerts`` of the batches that are committed."""
    return spark.read.schema(COMMIT).parquet(f"{path}/commits") if _exists(spark, f"{path}/commits") else spark.createDataFrame([], COMMIT)


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Committed alerts with ``feed_no``; what a broken delivery has left behind is not seen."""
    if not _exists(spark, f"{path}/alerts"):
        return spark.createDataFrame([], schema).withColumn("feed_no", F.lit(0).cast("bigint"))
    stored = StructType([*schema.fields, StructField("feed_no", LongType()), StructField("batch_id", LongType())])
    rows = spark.read.schema(stored).parquet(f"{path}/alerts")
    return rows.join(read_commits(spark, path).select("batch_id"), "batch_id", "left_semi").drop("batch_id")


def feed_sink(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends a batch's alerts in ``order``, numbered on from the batches before.

    The batch is written under its id, replacing an attempt that broke off, and counts from the moment
    its commit row stands; a batch whose commit stands is not delivered again.
    """

    def deliver(frame: DataFrame, batch_id: int) -> None:
        spark, own = frame.sparkSession, f"batch_id={batch_id}"
        if _exists(spark, f"{path}/commits/{own}/_SUCCESS"):
            return
        staged = f"{path}/staged/{own}"
        frame.write.mode("overwrite").parquet(staged)  # stateful operators run once a batch
        rows = spark.read.schema(frame.schema).parquet(staged)
        before = read_commits(spark, path).where(F.col("batch_id") < batch_id).agg(F.sum("alerts")).first()[0] or 0
        numbered = ordered(rows, [], order).running(feed_no=("sum", F.lit(1).cast("bigint"))).done()
        numbered.withColumn("feed_no", F.col("feed_no") + before).write.mode("overwrite").parquet(f"{path}/alerts/{own}")
        spark.range(1).select(F.lit(rows.count()).cast("bigint").alias("alerts")).write.mode("overwrite").parquet(f"{path}/commits/{own}")

    return deliver
