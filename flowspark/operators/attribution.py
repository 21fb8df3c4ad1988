"""Permutation Shapley attributions: coalitions as rows, scored by one transform."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permutation_shapley(
    df: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame], baseline: dict[str, float], permutations: int = 32, seed: int = 42
) -> DataFrame:
    """Mean marginal contribution of every feature over ``permutations`` seeded orders.

    A row explodes into permutations x (features + 1) coalitions; ``score`` adds column
    ``p`` to all of them at once.  Coalitions are narrow: key, order, position, features.
    """
    if not 2 <= permutations <= 256:
        raise ValueError("permutations must be between 2 and 256")
    if set(baseline) != set(features):
        raise ValueError("baseline must name exactly the features")
    n, rng = len(features), random.Random(seed)
    orders = [rng.sample(range(n), n) for _ in range(permutations)]
    # rank[o][f]: the position at which order o switches feature f from baseline to its value.
    ranks = [[order.index(f) + 1 for f in range(n)] for order in orders]
    table = F.array(*[F.array(*[F.lit(r) for r in rank]) for rank in ranks])
    steps = df.select(key, *features, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_order"))
    steps = steps.select(key, *features, "_order", F.get(table, F.col("_order")).alias("_ranks"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_at"))
    mixed = {c: F.when(F.get("_ranks", F.lit(i)) <= F.col("_at"), F.col(c)).otherwise(F.lit(float(baseline[c]))) for i, c in enumerate(features)}
    scored = score(steps.withColumns(mixed))
    # A path of n + 1 scores per (row, order): collected, bounded by the feature count.
    paths = scored.groupBy(key, "_order", "_ranks").agg(F.array_sort(F.collect_list(F.struct("_at", "p"))).alias("_path"))
    gain = F.transform("_ranks", lambda r: F.get("_path", r)["p"] - F.get("_path", r - 1)["p"])
    ends = paths.select(key, gain.alias("_gain"), F.get("_path", F.lit(0))["p"].alias("_base"), F.get("_path", F.lit(n))["p"].alias("_full"))
    names = F.array(*map(F.lit, features))
    flat = ends.select(key, "_base", "_full", F.posexplode("_gain").alias("_f", "_g"))
    return flat.groupBy(key, F.get(names, F.col("_f")).alias("feature")).agg(
        F.avg("_g").alias("attribution"),
        (F.stddev_samp("_g") / F.sqrt(F.lit(float(permutations)))).alias("standard_error"),
        F.avg("_base").alias("base_value"),
        F.avg("_full").alias("prediction"),
    )


def additivity_residual(attributions: DataFrame, key: str) -> DataFrame:
    return attributions.groupBy(key).agg(
        (F.first("prediction") - F.first("base_value") - F.sum("attribution")).alias("residual"), F.first("prediction").alias("prediction")
    )


def top_attributions(attributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` largest absolute attributions per row and the primary driver.

    One row's attributions are as many as features, so a sorted array per key suffices.
    """
    entry = F.struct((-F.abs("attribution")).alias("_size"), "feature", "attribution")
    ranked = attributions.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    top = F.slice("_all", 1, n)
    first = F.get("_all", F.lit(0))
    driver = F.when(first["attribution"] != 0, first["feature"]).otherwise("No current-feature contribution")
    return ranked.select(key, F.transform(top, lambda e: e["feature"]).alias("top"), driver.alias("primary_driver"))


def explanation_budget(alerts: DataFrame, batch: list[str], order: list[str], n: int) -> DataFrame:
    """Add ``explain``: whether the alert is among the first ``n`` of its batch."""
    from flowspark.operators.ordered import ordered

    rows = ordered(alerts, batch, order).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    return rows.withColumn("explain", F.col("_n") <= n).drop("_n")


def linear_score(weights: dict[str, float], intercept: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    total: Column = F.lit(intercept)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(weight)
    return lambda df: df.withColumn("p", total)
