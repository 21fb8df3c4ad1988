"""Labelled-flow dataset preparation: labels, duplicates, leaks, scaling and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.schemas import SPLITS, STAGES

# Floors and caps of scaling and class weights.
MIN_SCALE = 1e-3
POSITIVE_CAP, STAGE_CAP, FAMILY_CAP = 20.0, 10.0, 20.0


def label_map_errors(label_map: DataFrame) -> DataFrame:
    """Rows of a (label, attack, stage) map that contradict themselves, with ``error``."""
    attack, stage = F.col("attack"), F.col("stage")
    error = (
        F.when(attack.isNull() | ~attack.isin(0, 1), "attack_flag")
        .when(stage.isNotNull() & ~stage.between(0, len(STAGES) - 1), "stage_range")
        .when((stage == 0) & (attack != 0), "attack_with_benign_stage")
        .when((attack == 0) & (stage > 0), "benign_with_attack_stage")
    )
    return label_map.withColumn("error", error).where("error IS NOT NULL")


def apply_labels(df: DataFrame, label_map: DataFrame) -> DataFrame:
    """Inner join on the trimmed label; see :func:`unknown_labels` for what is missing."""
    mapped = label_map.select(F.col("label").alias("_label"), "attack", "stage")
    return df.join(mapped, F.trim("label") == F.col("_label")).drop("_label")


def unknown_labels(df: DataFrame, label_map: DataFrame) -> DataFrame:
    labels = df.groupBy(F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return labels.join(label_map.select("label"), "label", "left_anti")


def find_leaks(df: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Events that occur in two splits or carry contradictory labels."""
    state = F.struct("split", "attack", F.coalesce("stage", F.lit(-1)).alias("stage"))
    seen = df.groupBy(fingerprint).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(state).alias("_lo"),
        F.max(state).alias("_hi"),
        (F.min("split") != F.max("split")).alias("crosses_splits"),
    )
    contradictory = seen.where(F.col("_lo") != F.col("_hi"))
    return contradictory.select(fingerprint, "rows", "crosses_splits")


def dedupe_events(df: DataFrame, order: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """The first row of every event, by a partially aggregated minimum instead of a sort."""
    rest = [c for c in df.columns if c != fingerprint]
    first = df.groupBy(fingerprint).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(fingerprint, "_row.*")


def source_summary(df: DataFrame, keys: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Rows, duplicates removed and distinct nodes per source."""
    events = df.groupBy(*keys, fingerprint).agg(F.count(F.lit(1)).alias("_n"))
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("inserted"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates_removed"))
    ends = df.select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("_ip")).distinct()
    nodes = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    return counts.join(nodes, keys)


def fit_scaler(df: DataFrame, features: list[str], split: str = "train") -> DataFrame:
    """One row: mean and population deviation of log1p features over the training split."""
    logged = [F.log1p(c) for c in features]
    return df.where(F.col("split") == split).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(x).alias(f"mean_{c}") for c, x in zip(features, logged)],
        *[F.greatest(F.stddev_pop(x), F.lit(MIN_SCALE)).alias(f"scale_{c}") for c, x in zip(features, logged)],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(scaler.drop("rows")))  # one row
    scaled = {f"scaled_{c}": (F.log1p(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}") for c in features}
    return joined.withColumns(scaled).drop(*[f"{k}_{c}" for k in ("mean", "scale") for c in features])


def label_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def check_support(df: DataFrame) -> DataFrame:
    """Per required split: whether it has the classes training and evaluation need."""
    found = df.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("attacks"), F.count_if(F.col("label") == 0).alias("benign")
    )
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    rows = wanted.join(found, "split", "left").na.fill(0, ["attacks", "benign"])
    both = (F.col("attacks") > 0) & (F.col("benign") > 0)
    return rows.withColumn("supported", F.when(F.col("split") == "calibration", F.col("benign") > 0).otherwise(both))


def conversion_report(df: DataFrame, file: str = "file") -> DataFrame:
    """Per file: rows, accepted rows, and maps of rejection reasons and accepted labels."""
    counts = df.groupBy(file, "reason", "label").agg(F.count(F.lit(1)).alias("_n"))
    sums = df.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("accepted"))

    def as_map(rows: DataFrame, key: str) -> DataFrame:
        totals = rows.groupBy(file, key).agg(F.sum("_n").alias("_n"))
        pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_n").alias("value"))))
        return totals.groupBy(file).agg(F.map_from_entries(pairs).alias(f"{key}s"))

    reasons = as_map(counts.where("reason IS NOT NULL"), "reason")
    labels = as_map(counts.where("reason IS NULL"), "label")
    return sums.join(reasons, file, "left").join(labels, file, "left")


def binary_weight(df: DataFrame) -> DataFrame:
    """Positive-class weight of the training rows, capped."""
    counts = df.agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("attacks"))
    return counts.withColumn("positive_weight", F.least(F.lit(POSITIVE_CAP), F.sqrt(F.col("benign") / F.col("attacks"))))


def stage_weights(df: DataFrame) -> DataFrame:
    """Weight of every stage: root of the largest count over its own, kept in [1, cap]."""
    found = df.where("stage IS NOT NULL").groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))
    classes = df.sparkSession.range(len(STAGES)).select(F.col("id").cast("int").alias("stage"))
    rows = classes.join(found, "stage", "left").na.fill({"rows": 0})
    largest = F.broadcast(rows.agg(F.greatest(F.max("rows"), F.lit(1)).alias("_top")))  # one row
    weight = F.sqrt(F.col("_top") / F.greatest("rows", F.lit(1)))
    return rows.crossJoin(largest).select("stage", "rows", F.least(F.greatest(weight, F.lit(1.0)), F.lit(STAGE_CAP)).alias("weight"))


def family_weights(df: DataFrame, family: str = "family", benign: str = "benign") -> DataFrame:
    """Weight of every attack family against the largest, benign 1, mean 1 over the rows."""
    rows = df.groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("rows"))
    attack = F.col("family") != benign
    top = rows.agg(F.coalesce(F.max(F.when(attack, F.col("rows"))), F.lit(1)).alias("_top"))
    raw = F.when(attack, F.least(F.lit(FAMILY_CAP), F.sqrt(F.col("_top") / F.col("rows")))).otherwise(F.lit(1.0))
    weighted = rows.crossJoin(F.broadcast(top)).withColumn("_raw", raw)  # one row
    mean = weighted.agg((F.sum(F.col("_raw") * F.col("rows")) / F.sum("rows")).alias("_mean"))
    return weighted.crossJoin(F.broadcast(mean)).select("family", "rows", (F.col("_raw") / F.col("_mean")).alias("weight"))


def assert_none(bad: DataFrame, what: str) -> None:
    """Raise with one example when ``bad`` has a row."""
    example = bad.limit(1).collect()
    if example:
        raise ValueError(f"{what}: {example[0].asDict()}")


def reason_chain(*checks: tuple[Column, str]) -> Column:
    """First failing check's name, else NULL."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, name in checks:
        chain = chain.when(condition, name)
    return chain
