"""Order-dependent column operators that stay parallel when one key is hot.

A window partitioned by a key puts every row of that key into one task.  When the
largest key is small that is the best plan, and it is what runs.  Otherwise rows are
range-partitioned on (key, order) - the sampled ranges cut a hot key by position -
tagged with their slice, checkpointed, and every window runs per (slice, key).  What
crosses a slice boundary is one carried value per slice: at most one key continues
from one slice into the next, so the carry table never has more rows than slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import checkpointed, materialized, passing_shuffles

ROWS_PER_TASK = 4_000_000
#: Rows of a table of groups that may be broadcast.
GROUPS = 100_000
SLICE = "_slice"


class Ordered:
    """Rows with a total order inside each key; see :func:`ordered`."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], sliced: bool):
        self.df, self.keys, self.order, self.sliced = df, keys, order, sliced

    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, self.sliced)

    def _window(self) -> Window:
        parts = ([SLICE] if self.sliced else []) + self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def select(self, *columns) -> "Ordered":
        """Project, keeping the keys, the order and the slice."""
        keep = [c for c in (*self.keys, *self.order, *([SLICE] if self.sliced else []))]
        named = [c for c in columns if not (isinstance(c, str) and c in keep)]
        return self._with(self.df.select(*dict.fromkeys(keep), *named))

    def with_column(self, name: str, column: Column) -> "Ordered":
        return self._with(self.df.withColumn(name, column))

    def _carry(self, totals: dict[str, Column], combine: dict[str, callable]) -> DataFrame:
        per_slice = self.df.groupBy(SLICE, *self.keys).agg(*[c.alias(n) for n, c in totals.items()])
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        ranked = per_slice.select(
            SLICE,
            *self.keys,
            F.count(F.lit(1)).over(before).alias("_earlier"),
            *[combine[n](F.col(n)).over(before).alias(n) for n in totals],
        )
        return ranked.where("_earlier > 0").drop("_earlier")

    def _join_carry(self, carry: DataFrame) -> DataFrame:
        right = carry.select([F.col(c).alias(f"_r_{c}") for c in carry.columns])
        match = F.col(SLICE) == F.col(f"_r_{SLICE}")
        for key in self.keys:
            match = match & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        # At most one continuing key per slice: bounded by the slice count.
        joined = self.df.join(F.broadcast(right), match, "left")
        return joined.drop(*[f"_r_{c}" for c in (SLICE, *self.keys)])

    def lag(self, **columns: Column | str) -> "Ordered":
        """Previous row's value per key: ``lag(prev_ts="ts_us")``."""
        value = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
        window = self._window()
        if not self.sliced:
            out = self.df.withColumn("_lag", F.lag(value).over(window))
        else:
            last = F.max_by(value, F.struct(*self.order))
            carry = self._carry({"_last": last}, {"_last": lambda c: F.last(c)})
            base = Ordered(self._join_carry(carry), self.keys, self.order, True)
            out = base.df.withColumn("_lag", F.coalesce(F.lag(value).over(window), F.col("_r__last"))).drop("_r__last")
        out = out.select("*", *[F.col(f"_lag.{n}").alias(n) for n in columns]).drop("_lag")
        return self._with(out)

    def running(self, **columns: tuple[str, Column | str]) -> "Ordered":
        """Running value including the current row: ``running(total=("sum", "bytes"))``.

        Kinds: ``sum``, ``min``, ``max``, ``first`` and ``last`` (earliest and latest
        non-null value).
        """
        specs = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in columns.items()}
        window = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: _AGG[k](c).over(window) for n, (k, c) in specs.items()}
        if not self.sliced:
            return self._with(self.df.select("*", *[_finish(specs[n][0], c, None).alias(n) for n, c in local.items()]))
        totals, combine = {}, {}
        for name, (kind, column) in specs.items():
            if kind in ("first", "last"):
                pick = F.min_by if kind == "first" else F.max_by
                totals[name] = pick(column, F.when(column.isNotNull(), F.struct(*self.order)))
            else:
                totals[name] = _AGG[kind](column)
            combine[name] = _AGG[kind]
        joined = self._join_carry(self._carry(totals, combine))
        out = joined.select(
            "*", *[_finish(specs[n][0], c, F.col(f"_r_{n}")).alias(n) for n, c in local.items()]
        ).drop(*[f"_r_{n}" for n in specs])
        return self._with(out)

    def done(self) -> DataFrame:
        return self.df.drop(SLICE) if self.sliced else self.df


_AGG = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _finish(kind: str, local: Column, carry: Column | None) -> Column:
    if carry is None:
        return local
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "first":
        return F.coalesce(carry, local)
    return F.coalesce(local, carry)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the most frequent key, by one partially aggregated count."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    limit: int = ROWS_PER_TASK,
    largest: int | None = None,
) -> Ordered:
    """Prepare ``df`` for order-dependent columns per ``keys`` in ascending ``order``.

    ``order`` must identify a row inside its key.  A known upper bound of the rows of one
    key, ``largest``, saves the counting pass when it is within ``limit``.
    """
    if largest is not None and largest <= limit:
        return Ordered(df, keys, order, False)
    largest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if not largest or largest <= limit:
        return Ordered(df, keys, order, False)
    spark = df.sparkSession
    wanted = max(math.ceil(total / limit) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(wanted, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return Ordered(checkpointed(placed), keys, order, True)


def positions(df: DataFrame, keys: list[str], order: list[str], values: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """``keys``, ``_pos`` (1, 2, ... in ascending ``order`` inside each key) and ``values``.

    Beyond the limit the rows are sorted by one range exchange and written without their order, each with its
    slice and place in it; what earlier slices hold of its key is added when they are read again.  So the order,
    often the wider part, is shuffled once and not kept.
    """
    largest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if not largest or largest <= limit:
        rows = Ordered(df, keys, order, False).running(_pos=("sum", F.lit(1).cast("bigint"))).done()
        return rows.select(*keys, "_pos", *values)
    spark = df.sparkSession
    wanted = max(math.ceil(total / limit) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(wanted, *keys, *order).sortWithinPartitions(*keys, *order)
    with passing_shuffles(spark):
        rows = materialized(placed.select(*keys, *values, F.monotonically_increasing_id().alias("_at")), "placed")
    rows = rows.withColumn(SLICE, F.shiftright("_at", 33))
    groups = rows.groupBy(SLICE, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    shifts = materialized(groups.select(F.col(SLICE).alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], shift.alias("_shift")), "shifts")
    match = F.col(SLICE) == F.col("_s")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    # A row per slice and one more per key; a broadcast for as long as it is short.
    shifts = F.broadcast(shifts) if shifts.limit(GROUPS + 1).count() <= GROUPS else shifts
    return rows.join(shifts, match).select(*keys, (F.col("_at") + F.col("_shift")).alias("_pos"), *values)
