"""Evaluation statistics of binary scores and stage predictions.

Everything starts from counts: rows collapse to (group, score, label) before anything is
ordered, so curves run over distinct scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import is_close, safe_divide, wilson
from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.schemas import STAGES

# Log clip and the calibration error that counts as good.
LOG_CLIP = 1e-15
WELL_CALIBRATED = 0.05


def confusion(threshold: float | Column) -> list[Column]:
    hit, attack = F.col("p") >= threshold, F.col("label") == 1
    return [
        F.count_if(hit & attack).alias("tp"),
        F.count_if(hit & ~attack).alias("fp"),
        F.count_if(~hit & attack).alias("fn"),
        F.count_if(~hit & ~attack).alias("tn"),
        F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"),
    ]


def _log_loss() -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(LOG_CLIP)), F.lit(1 - LOG_CLIP))
    return F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log1p(-p)))


def _floored(n: Column, d: Column) -> Column:
    return n / F.greatest(d, F.lit(1))


def _ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": _floored(tp, tp + fp),
            "recall": _floored(tp, tp + fn),
            "f1": _floored(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": _floored(fp, fp + tn),
        }
    )


def binary_metrics(df: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates of ``p >= threshold`` against ``label`` in one aggregate."""
    return _ratios(df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("events"), *confusion(threshold)))


def extended_metrics(df: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Binary metrics with the rarer rates, definedness flags and Wilson intervals."""
    base = df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("events"), *confusion(threshold), _log_loss().alias("log_loss")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    attacks, benign, flagged = tp + fn, tn + fp, tp + fp
    recall, specificity = safe_divide(tp, attacks, None), safe_divide(tn, benign, None)
    product = flagged.cast("double") * attacks * benign * (tn + fn)
    return _ratios(base).withColumns(
        {
            "accuracy": (tp + tn) / F.col("events"),
            "prevalence": attacks / F.col("events"),
            "false_negative_rate": safe_divide(fn, attacks, None),
            "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
            "f2": _floored(5 * tp, 5 * tp + 4 * fn + fp),
            "mcc": safe_divide(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(product)),
            "precision_defined": flagged > 0,
            "recall_defined": attacks > 0,
            "fpr_defined": benign > 0,
            "precision_interval": wilson(tp, flagged),
            "recall_interval": wilson(tp, attacks),
            "fpr_interval": wilson(fp, benign),
        }
    )


def score_curve(df: DataFrame, keys: list[str] | None = None, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Running true and false positives by descending score, one row per distinct score."""
    keys = keys or []
    levels = df.groupBy(*keys, "p").agg(
        F.count_if(F.col("label") == 1).alias("tp_here"), F.count_if(F.col("label") == 0).alias("fp_here")
    )
    rows = ordered(levels.withColumn("_desc", -F.col("p")), keys, ["_desc"], limit)
    return rows.running(tp=("sum", "tp_here"), fp=("sum", "fp_here")).done().drop("_desc")


def rank_metrics(df: DataFrame, keys: list[str] | None = None, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Average precision and ROC AUC with tied scores grouped; NULL without a class."""
    keys = keys or []
    curve = score_curve(df, keys, limit)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    up, right = F.col("tp_here").cast("double"), F.col("fp_here").cast("double")
    sums = curve.groupBy(*keys).agg(
        F.sum(up * tp / (tp + fp)).alias("_ap"),
        F.sum(right * (2 * tp - up) / 2).alias("_area"),
        F.sum("tp_here").alias("positives"),
        F.sum("fp_here").alias("negatives"),
    )
    pos, neg = F.col("positives"), F.col("negatives")
    return sums.select(
        *keys,
        "positives",
        "negatives",
        safe_divide(F.col("_ap"), pos, None).alias("average_precision"),
        F.when((pos > 0) & (neg > 0), F.col("_area") / (pos.cast("double") * neg)).alias("roc_auc"),
    )


def choose_threshold(
    df: DataFrame,
    min_precision: float,
    max_fpr: float,
    min_recall: float = 0.0,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row (threshold, feasible): most true positives among scores meeting all limits,
    the highest such score on ties; (1.0, false) when none does."""
    curve = score_curve(df, [], limit)
    totals = df.agg(
        F.greatest(F.count_if(F.col("label") == 1), F.lit(1)).alias("_pos"),
        F.greatest(F.count_if(F.col("label") == 0), F.lit(1)).alias("_neg"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    meets = (
        (tp > 0)
        & (tp / (tp + fp) >= min_precision)
        & (fp / F.col("_neg") <= max_fpr)
        & (tp / F.col("_pos") >= min_recall)
    )
    # The totals are one row; this is a scalar, not a product of tables.
    best = curve.crossJoin(F.broadcast(totals)).where(meets).agg(F.max(F.struct("tp", "p")).alias("_best"))
    return best.select(
        F.coalesce("_best.p", F.lit(1.0)).alias("threshold"), F.col("_best").isNotNull().alias("feasible")
    )


def reliability(df: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """All equal-width bins with count, accuracy, confidence and gap rounded to 4; last bin closed."""
    keys = keys or []
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    index = F.size(F.filter(edges, lambda e: F.col("p") >= e)).cast("int")
    found = df.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("label").alias("_acc"), F.avg("p").alias("_conf")
    )
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = grid.join(found, [*keys, "bin"], "left").na.fill({"count": 0, "_acc": 0.0, "_conf": 0.0})
    return rows.select(
        *keys,
        "bin",
        "count",
        F.round("_acc", 4).alias("accuracy"),
        F.round("_conf", 4).alias("confidence"),
        F.round(F.abs(F.col("_acc") - F.col("_conf")), 4).alias("gap"),
    )


def ece(df: DataFrame, bins: int = 10, rule: str = "edges", keys: list[str] | None = None) -> DataFrame:
    """Expected calibration error.  ``edges`` rounds to 4 and judges it; ``floor`` bins by
    floor(p * bins) capped at the last and keeps full precision."""
    keys = keys or []
    if rule == "edges":
        edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        index = F.size(F.filter(edges, lambda e: F.col("p") >= e))
    elif rule == "floor":
        index = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    else:
        raise ValueError(f"unknown bin rule {rule!r}")
    found = df.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg("label") - F.avg("p")).alias("gap")
    )
    total = found.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    if rule == "floor":
        return total
    return total.select(*keys, F.round("ece", 4).alias("ece"), (F.col("ece") < WELL_CALIBRATED).alias("well_calibrated"))


def stage_confusion(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of (stage, stage_pred) over rows with a known stage, the full grid."""
    keys = keys or []
    counts = df.where("stage IS NOT NULL").groupBy(*keys, "stage", "stage_pred").agg(F.count(F.lit(1)).alias("rows"))
    classes = F.sequence(F.lit(0), F.lit(len(STAGES) - 1))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("stage", F.explode(classes)).withColumn("stage_pred", F.explode(classes))
    return grid.join(counts, [*keys, "stage", "stage_pred"], "left").na.fill({"rows": 0})


def stage_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Support, precision, recall and F1 per class; NULL where undefined."""
    keys = keys or []
    grid = stage_confusion(df, keys)
    sides = F.array(
        F.struct(F.col("stage").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("stage_pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("predicted")),
    )
    hit = F.when(F.col("stage") == F.col("stage_pred"), F.col("rows")).otherwise(0)
    parts = grid.select(*keys, hit.alias("_hit"), F.posexplode(sides).alias("_i", "_s"))
    per_class = parts.groupBy(*keys, F.col("_s.class").alias("stage")).agg(
        F.sum("_s.support").alias("support"),
        F.sum("_s.predicted").alias("predicted_support"),
        F.sum(F.when(F.col("_i") == 0, F.col("_hit")).otherwise(0)).alias("hits"),
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted_support")
    return per_class.select(
        *keys,
        "stage",
        "support",
        "predicted_support",
        "hits",
        safe_divide(hits, predicted, None).alias("precision"),
        safe_divide(hits, support, None).alias("recall"),
        safe_divide(2 * hits, support + predicted, None).alias("f1"),
    )


def stage_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro F1 over observed labels and over present classes, and accuracy."""
    report = stage_report(df, keys)
    return report.groupBy(*(keys or [])).agg(
        F.sum("support").alias("supervised_rows"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_observed"),
        F.avg("f1").alias("macro_f1_present"),
        safe_divide(F.sum("hits"), F.sum("support"), None).alias("stage_accuracy"),
    )


def evaluation_report(df: DataFrame, threshold: float, capture: str = "capture") -> DataFrame:
    """Binary metrics per capture and for all rows (NULL capture) in one aggregate."""
    grouped = df.groupingSets([[F.col(capture)], []], F.col(capture)).agg(
        F.count(F.lit(1)).alias("events"), *confusion(threshold)
    )
    return _ratios(grouped)


def target_check(report: DataFrame, min_precision: float, min_recall: float, max_fpr: float) -> DataFrame:
    """Add ``failed`` (array of metric names) and ``met``; a metric without rows cannot fail."""
    attacks, benign = F.col("tp") + F.col("fn") > 0, F.col("tn") + F.col("fp") > 0
    silent = F.col("tp") + F.col("fp") == 0
    failed = F.array_compact(
        F.array(
            F.when(attacks & (silent | (F.col("precision") < min_precision)), "precision"),
            F.when(attacks & (F.col("recall") < min_recall), "recall"),
            F.when(benign & (F.col("false_positive_rate") > max_fpr), "false_positive_rate"),
        )
    )
    return report.withColumn("failed", failed).withColumn("met", F.size("failed") == 0)


def protocol_verdict(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Passes only when the aggregate and every capture pass."""
    return checked.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(~F.col("met")).alias("failing"), F.bool_and("met").alias("all_met")
    )


def audit_reports(reports: DataFrame, chunks: DataFrame, key: str = "report", atol: float = 1e-12) -> DataFrame:
    """Saved reports against their own counts: metrics that do not follow, and chunk sums that do not add up."""
    counts = ["tn", "fp", "fn", "tp"]
    sums = chunks.groupBy(key).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    expected = {
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn),
        "f1": safe_divide(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": safe_divide(fp, fp + tn),
    }
    wrong = F.array_compact(F.array(*[F.when(~is_close(F.col(n), e, atol=atol), n) for n, e in expected.items()]))
    add_up = F.lit(True)
    for c in counts:
        add_up = add_up & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = reports.join(sums, key, "left")
    return joined.select(key, wrong.alias("inconsistent"), add_up.alias("chunks_match"))


def best_candidate(history: DataFrame, candidate: str, scores: list[str], keys: list[str] | None = None) -> DataFrame:
    """The candidate with the largest score tuple; the first one on full ties."""
    return history.groupBy(*(keys or [])).agg(
        F.max_by(candidate, F.struct(*scores, (-F.col(candidate)).alias("_first"))).alias("best")
    )
