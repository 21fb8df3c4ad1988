"""Shared helpers: text expressions, checked broadcasts, connected components."""

from __future__ import annotations

import string
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.session import checkpointed, fresh_dir, materialized  # noqa: F401  re-exported

T = TypeVar("T")
#: Broadcasting needs fewer rows than this; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Edges that a task writes at least, if there are so many.
EDGES = 100_000
SPACE = r"[\x20\x09-\x0D]+"
#: What this Python worker keeps from task to task, by the work that it is for.
_kept: dict = {}


def kept_for(work: tuple, make: Callable[[], T]) -> T:
    """What a worker has kept since an earlier task of the same work; other work that keeps something, if only
    nothing, has dropped it.  Workers go on to other stages, where it would be memory that nobody reads."""
    if work not in _kept:
        _kept.clear()
        _kept[work] = make()
    return _kept[work]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged; texts of ASCII only take the faster ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; no text has no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def at(words: Column, index: Column) -> Column:
    """Element at a zero-based index, null outside."""
    return F.get(words, index)


def starts(n: Column, width: int) -> Column:
    """0 .. n - width, and 0 alone for fewer elements."""
    return F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the frame's rows."""
    return F.broadcast(df) if is_small(df, rows) else df


def in_tasks_of(df: DataFrame, most: int, rows: int) -> DataFrame:
    """``df``, of at most ``most`` rows, in tasks of about ``rows`` or as many as it has: a short table in a
    file a shuffle partition is all file handling.  The session's cores stay busy."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // rows)))


class Scratch:
    """Tables of one computation in the shared folder, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame | None) -> None:
        for kept in tables:
            _, path = self.paths.pop(id(kept), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` to ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps: each node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  Rows never exceed the edges, no neighbourhood
    is gathered, and every round is checkpointed.  Null ends and self-loops are dropped.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    mark, most = None, edges.count()
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        # A large-star row is an edge's, and gives two rows at most.
        edges = checkpointed(in_tasks_of(small.select("e.u", "e.v").where("u <> v").distinct(), 2 * most, EDGES))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        mark, most = tuple(now), now[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def running_total(df: DataFrame, keys: list[str], order: str, ties: list[str], amount: str, buckets: int = 1024) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over earlier rows of the key, by ``order`` in [0, 1)
    and, where equal, by ``ties``.

    Keys are not null.  They are cut into buckets of the order, so a hot key is spread over many tasks; only one row
    per key and bucket is summed along a key.
    """
    cut = df.withColumn("_bucket", F.floor(F.col(order) * buckets).cast("int"))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum")
    joined = cut.join(sums, [*keys, "_bucket"])
    within = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("before", F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_base", "_bucket")
