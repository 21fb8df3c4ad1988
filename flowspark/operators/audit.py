"""Dataset audits: consistency, conflicts, samples, overlap and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import is_close
from flowspark.operators.ordered import ROWS_PER_TASK, ordered, positions

# Tolerances of the algebra checks.
RTOL = ATOL = 0.01


def exact_medians(df: DataFrame, keys: list[str], features: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Exact median of every feature per group, from counts of distinct values.

    A running count over distinct values finds the middle ranks, so no task holds a group.
    """
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    flat = df.select(*keys, F.explode(names).alias("_x")).select(*keys, "_x.*").where("value IS NOT NULL")
    group = [*keys, "feature"]
    levels = flat.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_here"))
    rows = ordered(levels, group, ["value"], limit).running(_through=("sum", "_here")).done()
    sizes = levels.groupBy(*group).agg(F.sum("_here").alias("_n"))
    joined = rows.join(sizes, group)
    lower, upper = F.ceil(F.col("_n") / 2), F.floor(F.col("_n") / 2) + 1
    middle = joined.groupBy(*group).agg(
        F.min(F.when(F.col("_through") >= lower, F.col("value"))).alias("_lo"),
        F.min(F.when(F.col("_through") >= upper, F.col("value"))).alias("_hi"),
    )
    wide = [F.max(F.when(F.col("feature") == f, (F.col("_lo") + F.col("_hi")) / 2)).alias(f"median_{f}") for f in features]
    return middle.groupBy(*keys).agg(*wide)


def feature_audit(
    df: DataFrame, keys: list[str], features: list[str], checks: dict[str, tuple[Column, Column, Column]]
) -> DataFrame:
    """Per group: rows, exact medians, and for every (numerator, denominator, observed)
    the eligible rows and those where the quotient disagrees."""
    columns = [F.count(F.lit(1)).alias("rows")]
    for name, (numerator, denominator, observed) in checks.items():
        eligible = denominator > 0
        agrees = is_close(numerator / F.when(eligible, denominator), observed, RTOL, ATOL)
        columns.append(F.count_if(eligible).alias(f"eligible_{name}"))
        columns.append(F.count_if(eligible & ~agrees).alias(f"mismatches_{name}"))
    return df.groupBy(*keys).agg(*columns).join(exact_medians(df, keys, features), keys)


def label_conflicts(df: DataFrame, vector: str, label: str, capture: str) -> DataFrame:
    """Vectors seen with both labels: overall (NULL capture) and within each capture.

    Rows first collapse to the label set of every (vector, capture).
    """
    seen = df.groupBy(vector, capture).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    overall = seen.groupBy(vector).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    overall = overall.withColumn(capture, F.lit(None).cast(df.schema[capture].dataType))
    both = seen.unionByName(overall)
    return both.groupBy(capture).agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting")
    )


def priority_sample(df: DataFrame, strata: list[str], identity: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per stratum, those with the smallest seeded hash (MD5) of their identity.

    The rank filter is applied on the map side as well, so a large stratum ships n rows
    per task, not all of them.
    """
    key = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(key, *identity))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def absent_from(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct candidates that the reference never holds."""
    return candidates.distinct().exceptAll(reference.distinct())


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def compare_exports(
    left: DataFrame, right: DataFrame, keys: list[str], order: list[str], n: int | None = None, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Pair two exports by row position and count rows equal on all common columns.

    Rows of the longer export that have no partner are counted as unpaired.
    """
    common = [c for c in left.columns if c in right.columns and c not in (*keys, *order)]

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = positions(df.select(*keys, *order, *common), keys, order, common, limit)
        rows = rows if n is None else rows.where(F.col("_pos") <= n)
        return rows.select(*keys, "_pos", F.struct(*common).alias(side))

    paired = placed(left, "_l").withColumn("_in_l", F.lit(True)).join(placed(right, "_r").withColumn("_in_r", F.lit(True)), [*keys, "_pos"], "full")
    both = F.coalesce(F.col("_in_l") & F.col("_in_r"), F.lit(False))
    return paired.groupBy(*keys).agg(
        F.lit(len(common)).alias("common_columns"),
        F.count_if(both).alias("checked_rows"),
        F.count_if(both & F.col("_l").eqNullSafe(F.col("_r"))).alias("matching_rows"),
        F.count_if(~both).alias("unpaired_rows"),
    )


def files_per_folder(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("folder").agg(F.count(F.lit(1)).alias("files")).orderBy("folder")
