"""A ledger fed by one streaming query: one block per non-empty micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ledger import new_block
from flowspark.operators.ordered import ordered

BLOCKS = "batch_id bigint, block_index bigint, timestamp string, prev_block_hash string, merkle_root string, leaf_count bigint, block_hash string"
LEAVES = "batch_id bigint, pos bigint, leaf string"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select(*[c.split()[0] for c in BLOCKS.split(", ")])


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEAVES).parquet(f"{path}/leaves")


def _written(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks")
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def ledger_sink(path: str, order: list[str], leaf: str = "leaf", ts_us: str = "ts_us") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits the batch's leaf hashes in ``order``.

    A replayed batch overwrites its own partition with the same block, as its parent is the
    last block of an earlier batch and its time the latest event of the batch.
    """

    def commit(frame: DataFrame, batch_id: int) -> None:
        if frame.isEmpty():
            return
        spark = frame.sparkSession
        rows = ordered(frame, [], order).running(_n=("sum", F.lit(1).cast("bigint"))).done()
        target = f"{path}/leaves/batch_id={batch_id}"
        rows.select((F.col("_n") - 1).alias("pos"), F.col(leaf).alias("leaf"), F.col(ts_us).alias("_ts")).write.mode("overwrite").parquet(target)
        leaves = spark.read.schema("pos bigint, leaf string, _ts bigint").parquet(target)
        last = None
        if _written(spark, path):
            earlier = read_blocks(spark, path).where(F.col("batch_id") < batch_id)
            found = earlier.agg(F.max(F.struct("block_index", "block_hash"))).first()[0]
            last = (found[0], found[1]) if found else None
        latest = leaves.agg(F.max("_ts")).first()[0]
        block = new_block(leaves, last, f"{latest // 1_000_000}.{latest % 1_000_000:06d}")
        block.write.mode("overwrite").parquet(f"{path}/blocks/batch_id={batch_id}")

    return commit
