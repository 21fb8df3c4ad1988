"""Split-conformal calibration: quantiles, p-values and prediction sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.operators.respond import conformal_set, high_risk
from flowspark.schemas import STAGES

# Threshold before calibration; critical stages of a set.
UNCALIBRATED_Q = 0.85
CRITICAL = ["lateral_movement", "command_and_control", "impact"]


def conformal_q(scores: DataFrame, alpha: float, keys: list[str] | None = None, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Quantile per group over column ``score``: the k-th smallest, k = ceil((n + 1)(1 - alpha)),
    or 1.0 when k > n.  Counted over distinct scores."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    keys = keys or []
    levels = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n"))
    rows = ordered(levels, keys, ["score"], limit).running(_through=("sum", "_n")).done()
    sizes = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rank = F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha))
    if keys:
        joined = rows.join(sizes, keys)
    else:
        joined = rows.crossJoin(F.broadcast(sizes))  # one row
    out = joined.groupBy(*keys, "n").agg(F.min(F.when(F.col("_through") >= rank, F.col("score"))).alias("q"))
    return out.select(*keys, "n", rank.cast("bigint").alias("rank"), F.coalesce("q", F.lit(1.0)).alias("q"))


def invalid_probability_row(probs: Column, y: Column) -> Column:
    """Reason a calibration row is unusable, else NULL."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    in_range = F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1))
    return (
        F.when(~in_range, "probability_range")
        .when(F.abs(total - 1) > 1e-8 + 1e-5, "probability_sum")
        .when((y < 0) | (y >= F.size(probs)), "label_range")
    )


def conformal_q_multi(rows: DataFrame, alpha: float, keys: list[str] | None = None) -> DataFrame:
    """Quantile of 1 - probability of the true class; raises on an invalid row when run."""
    reason = invalid_probability_row(F.col("probs"), F.col("y"))
    score = 1 - F.get("probs", F.col("y").cast("int"))
    checked = F.when(reason.isNull(), score).otherwise(F.raise_error(reason).cast("double"))
    return conformal_q(rows.select(*(keys or []), checked.alias("score")), alpha, keys)


def p_value(scored: DataFrame, benign: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``p_value`` = (1 + benign scores >= p) / (n + 1); 1.0 with no calibration rows.

    A running count over the union of distinct scores, joined back by score: no row meets
    more than one calibration level.
    """
    levels = benign.groupBy(F.col("score").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_asked"))
    asked = scored.select(F.col("p").alias("_s")).distinct().withColumns({"_n": F.lit(0).cast("bigint"), "_asked": F.lit(1)})
    merged = levels.unionByName(asked).groupBy("_s").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    rows = ordered(merged.withColumn("_desc", -F.col("_s")), [], ["_desc"], limit).running(_above=("sum", "_n"))
    total = benign.agg(F.count(F.lit(1)).alias("_total"))
    table = rows.done().where("_asked = 1").crossJoin(F.broadcast(total))  # one row
    value = table.select(F.col("_s").alias("p"), ((F.col("_above") + 1) / (F.col("_total") + 1)).alias("p_value"))
    return scored.join(value, "p", "left")


def conformal_verdict(
    scored: DataFrame, benign: DataFrame, alpha: float, threshold: float = 0.85, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """P-value, confirmation, binary prediction set and the high-risk decision."""
    q = conformal_q(benign, alpha, limit=limit).select(F.col("q").alias("_q"), F.col("n").alias("_n"))
    rows = p_value(scored, benign, limit).join(F.broadcast(q), how="left")  # one row
    calibrated = F.coalesce(F.col("_n"), F.lit(0)) > 0
    q_hat = F.when(calibrated, F.col("_q")).otherwise(F.lit(UNCALIBRATED_Q))
    p = F.col("p")
    members = F.array_compact(F.array(F.when(p < q_hat, "benign"), F.when(p >= 1 - q_hat, "attack")))
    fallback = F.array(F.when(p >= 0.5, "attack").otherwise("benign"))
    confirmed = calibrated & (F.col("p_value") <= alpha)
    return rows.select(
        *scored.columns,
        F.when(calibrated, F.col("p_value")).otherwise(F.lit(1.0)).alias("p_value"),
        q_hat.alias("q_hat"),
        confirmed.alias("confirmed"),
        F.when(F.size(members) > 0, members).otherwise(fallback).alias("prediction_set"),
        high_risk(p, confirmed, calibrated, threshold).alias("high_risk"),
    )


def stage_sets(rows: DataFrame, q: Column | None = None) -> DataFrame:
    """Stage prediction sets; every class qualifies while uncalibrated (``q`` is None)."""
    level = F.lit(1.0) if q is None else q
    out = rows.withColumn("stage_set", conformal_set(F.col("probs"), level, STAGES))
    critical = F.arrays_overlap("stage_set", F.array(*map(F.lit, CRITICAL)))
    return out.withColumns(
        {"set_size": F.size("stage_set"), "is_singleton": F.size("stage_set") == 1, "has_critical": critical}
    )


def coverage_text(alpha: float) -> str:
    return f"{math.floor((1 - alpha) * 100)}% under exchangeability"
