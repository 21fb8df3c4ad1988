"""Evaluation, calibration and feature audits over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import audit, calibrate, evaluate, respond
from flowspark.plans import views as v
from flowspark.schemas import STAGES

RATES = ["brier", "precision", "recall", "f1", "false_positive_rate"]
EXTENDED = [
    "log_loss", "accuracy", "prevalence", "false_negative_rate", "specificity", "balanced_accuracy", "f2", "mcc",
]


def _test(spark, sf):
    return v.scored_v(spark, sf).where("split = 'test'")


def _benign(spark, sf):
    rows = v.scored_v(spark, sf).where("split = 'calibration' AND label = 0")
    return rows.select(F.col("p").alias("score"))


def decisions(spark, sf):
    rows = v.scored_v(spark, sf).withColumn("hit", respond.decide(F.col("p"), 0.7))
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("hits"))


def binary_metrics(spark, sf):
    return v.rounded(evaluate.binary_metrics(v.scored_v(spark, sf), 0.5, ["split"]), RATES)


def extended_metrics(spark, sf):
    rows = evaluate.extended_metrics(v.scored_v(spark, sf), 0.5, ["split"])
    bounds = {
        f"{n}_{b}": F.col(f"{n}_interval.{b}") for n in ("precision", "recall", "fpr") for b in ("low", "high")
    }
    flat = rows.withColumns(bounds).drop("precision_interval", "recall_interval", "fpr_interval")
    return v.rounded(flat, RATES + EXTENDED + list(bounds))


def score_curve(spark, sf):
    return evaluate.score_curve(v.scored_v(spark, sf), ["split"])


def rank_metrics(spark, sf):
    return v.rounded(evaluate.rank_metrics(v.scored_v(spark, sf), ["split"]), ["average_precision", "roc_auc"])


def threshold_choice(spark, sf):
    validation = v.scored_v(spark, sf).where("split = 'validation'")
    loose = evaluate.choose_threshold(validation, 0.2, 0.5).withColumn("targets", F.lit("loose"))
    strict = evaluate.choose_threshold(validation, 0.95, 0.001, 0.95).withColumn("targets", F.lit("strict"))
    return loose.unionByName(strict)


def reliability_table(spark, sf):
    return evaluate.reliability(v.scored_v(spark, sf), 15, ["split"])


def calibration_error(spark, sf):
    edges = evaluate.ece(v.scored_v(spark, sf), 10, "edges", ["split"])
    floor = v.rounded(evaluate.ece(v.scored_v(spark, sf), 10, "floor", ["split"]), ["ece"])
    return edges.join(floor.withColumnRenamed("ece", "ece_floor"), "split")


def stage_confusion(spark, sf):
    return evaluate.stage_confusion(v.scored_v(spark, sf), ["split"])


def stage_report(spark, sf):
    return v.rounded(evaluate.stage_report(_test(spark, sf)), ["precision", "recall", "f1"])


def stage_summary(spark, sf):
    rows = evaluate.stage_summary(v.scored_v(spark, sf), ["split"])
    return v.rounded(rows, ["macro_f1_observed", "macro_f1_present", "stage_accuracy"])


def evaluation_report(spark, sf):
    return v.rounded(evaluate.evaluation_report(_test(spark, sf), 0.5), RATES)


def target_check(spark, sf):
    report = evaluate.evaluation_report(_test(spark, sf), 0.5)
    checked = evaluate.target_check(report, 0.2, 0.55, 0.6)
    return checked.select("capture", F.array_join("failed", ",").alias("failed"), "met")


def protocol_verdict(spark, sf):
    report = evaluate.evaluation_report(v.scored_v(spark, sf), 0.5)
    return evaluate.protocol_verdict(evaluate.target_check(report, 0.2, 0.4, 0.6))


def holdout_protocol(spark, sf):
    """Threshold from validation, quantile from calibration, report on test only."""
    rows = v.scored_v(spark, sf)
    threshold = evaluate.choose_threshold(rows.where("split = 'validation'"), 0.2, 0.5)
    q = calibrate.conformal_q(_benign(spark, sf), 0.1).select("q")
    point = threshold.crossJoin(q)  # one row each
    test = rows.where("split = 'test'").crossJoin(F.broadcast(point))
    report = test.groupBy("threshold", "feasible", "q").agg(
        F.count(F.lit(1)).alias("events"), *evaluate.confusion(F.col("threshold"))
    )
    return v.rounded(report, ["brier", "q"])


def conformal_quantile(spark, sf):
    parts = [
        calibrate.conformal_q(_benign(spark, sf), a).withColumn("alpha", F.lit(a)) for a in (0.01, 0.1, 0.5)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def conformal_quantile_by_capture(spark, sf):
    rows = v.scored_v(spark, sf).where("label = 0").select("capture", F.col("p").alias("score"))
    return calibrate.conformal_q(rows, 0.2, ["capture"])


def stage_quantile(spark, sf):
    return v.rounded(calibrate.conformal_q_multi(v.stage_probs_v(spark, sf), 0.1), ["q"])


def p_values(spark, sf):
    rows = calibrate.p_value(_test(spark, sf), _benign(spark, sf))
    return rows.groupBy("p", F.round("p_value", 9).alias("p_value")).agg(F.count(F.lit(1)).alias("rows"))


def conformal_verdicts(spark, sf):
    rows = calibrate.conformal_verdict(_test(spark, sf), _benign(spark, sf), 0.2, 0.7)
    sets = F.array_join("prediction_set", ",").alias("prediction_set")
    return rows.groupBy("p", sets, "confirmed", "high_risk").agg(F.count(F.lit(1)).alias("rows"))


def stage_prediction_sets(spark, sf):
    rows = v.stage_probs_v(spark, sf)
    q = calibrate.conformal_q_multi(rows, 0.5).select(F.round("q", 9).alias("_q"))
    sets = calibrate.stage_sets(rows.crossJoin(F.broadcast(q)), F.col("_q"))
    return sets.select("vec_id", F.array_join("stage_set", ",").alias("stages"), "set_size", "is_singleton", "has_critical")


def critical_set_algebra(spark, sf):
    """Which part of every stage set is critical."""
    rows = calibrate.stage_sets(v.stage_probs_v(spark, sf), F.lit(0.85))
    gate = F.array(*map(F.lit, respond.GATE_STAGES))
    inside, outside = F.array_intersect("stage_set", gate), F.array_except("stage_set", gate)
    return rows.select(
        "vec_id",
        F.array_join(F.array_sort(inside), ",").alias("inside"),
        F.array_join(F.array_sort(outside), ",").alias("outside"),
        ((F.size(outside) == 0) & (F.size("stage_set") > 0)).alias("subset"),
    )


def feature_audit(spark, sf):
    """Medians and algebra mismatches of order-line amounts per split and capture."""
    line = v.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_partkey")
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    year = F.year("l_shipdate")
    split = F.when(year <= 1997, "train").when(year == 1998, "validation").when(year == 1999, "calibration").otherwise("test")
    rows = line.join(part, "l_partkey").select(split.alias("split"), year.alias("capture"), "l_quantity", "l_extendedprice", "l_discount", "p_retailprice")
    checks = {"unit_price": (F.col("l_extendedprice"), F.col("l_quantity"), F.col("p_retailprice"))}
    out = audit.feature_audit(rows, ["split", "capture"], ["l_quantity", "l_extendedprice", "l_discount"], checks)
    return v.rounded(out, ["median_l_quantity", "median_l_extendedprice", "median_l_discount"])


def _vectors(spark, sf):
    line = v.table(spark, sf, "lineitem")
    return line.select(
        F.struct("l_quantity", "l_discount", "l_tax").alias("vector"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.year("l_shipdate").alias("capture"),
    )


def label_conflicts(spark, sf):
    return audit.label_conflicts(_vectors(spark, sf), "vector", "label", "capture")


def report_audit(spark, sf):
    """Chunk counts per capture against the saved aggregate, with one report gone stale."""
    rows = v.scored_v(spark, sf)
    chunks = evaluate.binary_metrics(rows, 0.5, ["split", "capture"])
    saved = evaluate.extended_metrics(rows, 0.5, ["split"])
    stale = F.when(F.col("split") == "test", F.col("recall") + 0.01).otherwise(F.col("recall"))
    checked = evaluate.audit_reports(saved.withColumn("recall", stale), chunks, "split")
    return checked.select("split", F.array_join("inconsistent", ",").alias("inconsistent"), "chunks_match")


def priority_sample(spark, sf):
    """The rows of each stratum, 512 at most, with the smallest seeded hashes: a sampling operator."""
    line = v.table(spark, sf, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    strata = line.withColumn("capture", F.year("l_shipdate"))
    sample = audit.priority_sample(strata, ["capture", "l_returnflag"], ["row_key"], 512, 42)
    return sample.select("capture", "l_returnflag", "row_key")


def families_absent_from_training(spark, sf):
    """Part types sold in validation or test but never in training."""
    line = v.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_suppkey")
    year = F.year("l_shipdate")
    kind = F.concat_ws("/", "l_partkey", "l_suppkey").alias("family")
    train, later = line.where(year <= 1997).select(kind), line.where((year == 1998) | (year >= 2000)).select(kind)
    return audit.absent_from(later, train)


def train_validation_overlap(spark, sf):
    line = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.year("l_shipdate").alias("year"))
    return audit.overlap(line.where("year <= 1997").select("order_key"), line.where("year = 1998").select("order_key"))


QUERIES = {
    f.__name__: f
    for f in (
        decisions,
        binary_metrics,
        extended_metrics,
        score_curve,
        rank_metrics,
        threshold_choice,
        reliability_table,
        calibration_error,
        stage_confusion,
        stage_report,
        stage_summary,
        evaluation_report,
        target_check,
        protocol_verdict,
        holdout_protocol,
        conformal_quantile,
        conformal_quantile_by_capture,
        stage_quantile,
        p_values,
        conformal_verdicts,
        stage_prediction_sets,
        critical_set_algebra,
        feature_audit,
        label_conflicts,
        report_audit,
        priority_sample,
        families_absent_from_training,
        train_validation_overlap,
    )
}

_S = f"WITH {v.SCORED}"
_PS = f"WITH {v.STAGE_PROBS}"


def _counts(t: str = "0.5") -> str:
    return f"""count(*) FILTER (p >= {t} AND label = 1) AS tp, count(*) FILTER (p >= {t} AND label = 0) AS fp,
  count(*) FILTER (p < {t} AND label = 1) AS fn, count(*) FILTER (p < {t} AND label = 0) AS tn,
  round(avg((p - label) * (p - label)), 6) AS brier"""


_RATES = """round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS false_positive_rate"""
_Z = 1.959963984540054


def _wilson(k: str, n: str, name: str) -> str:
    p, z = f"({k} / nullif({n}, 0))", _Z
    centre = f"({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    radius = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n})) / (1 + {z * z} / {n})"
    return (
        f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {centre} - {radius}), 6) END::DOUBLE AS {name}_low, "
        f"CASE WHEN {n} > 0 THEN round(least(1.0, {centre} + {radius}), 6) END::DOUBLE AS {name}_high"
    )


_CURVE = """levels AS (SELECT split, p, count(*) FILTER (label = 1) AS tp_here, count(*) FILTER (label = 0) AS fp_here FROM scored_v GROUP BY 1, 2),
curve AS (SELECT *, CAST(sum(tp_here) OVER (PARTITION BY split ORDER BY p DESC) AS BIGINT) AS tp,
  CAST(sum(fp_here) OVER (PARTITION BY split ORDER BY p DESC) AS BIGINT) AS fp FROM levels)"""


def _choice(precision: float, fpr: float, recall: float, name: str) -> str:
    return f"""SELECT coalesce(max(p) FILTER (tp = best), 1.0)::DOUBLE AS threshold, count(p) > 0 AS feasible, '{name}' AS targets
  FROM (SELECT *, max(tp) OVER () AS best FROM curve, (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
      FROM scored_v WHERE split = 'validation') t
    WHERE split = 'validation' AND tp > 0 AND tp / (tp + fp) >= {precision} AND fp / neg <= {fpr} AND tp / pos >= {recall}) e"""


_STAGE_GRID = """grid AS (SELECT s.split, a.stage, b.stage_pred FROM (SELECT DISTINCT split FROM scored_v) s,
  (SELECT CAST(unnest(range(8)) AS INT) AS stage) a, (SELECT CAST(unnest(range(8)) AS INT) AS stage_pred) b),
counted AS (SELECT split, stage, stage_pred, count(*) AS rows FROM scored_v WHERE stage IS NOT NULL GROUP BY 1, 2, 3),
conf AS (SELECT split, stage, stage_pred, coalesce(rows, 0) AS rows FROM grid LEFT JOIN counted USING (split, stage, stage_pred)),
per_class AS (SELECT split, stage, support, predicted_support, hits FROM
  (SELECT split, stage, CAST(sum(rows) AS BIGINT) AS support, CAST(sum(rows) FILTER (stage = stage_pred) AS BIGINT) AS hits FROM conf GROUP BY 1, 2) a
  JOIN (SELECT split, stage_pred AS stage, CAST(sum(rows) AS BIGINT) AS predicted_support FROM conf GROUP BY 1, 2) b USING (split, stage)),
class_f1 AS (SELECT *, CASE WHEN support + predicted_support > 0 THEN 2 * hits / (support + predicted_support) END AS f1 FROM per_class)"""
_REPORT = f"""report AS (SELECT capture, count(*) AS events, {_counts()} FROM {{src}} GROUP BY GROUPING SETS ((capture), ()))"""
_CHECK = """failing AS (SELECT *, tp + fn > 0 AND (tp + fp = 0 OR tp / greatest(tp + fp, 1) < {p}) AS f1, tp + fn > 0 AND tp / greatest(tp + fn, 1) < {r} AS f2,
  tn + fp > 0 AND fp / greatest(fp + tn, 1) > {f} AS f3 FROM report)"""
_BENIGN = "benign AS (SELECT p AS score FROM scored_v WHERE split = 'calibration' AND label = 0)"


def _quantile(source: str, alpha: float, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    pick = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {pick}max(n) AS n, CAST(max(k) AS BIGINT) AS rank, coalesce(max(score) FILTER (rn = k), 1.0)::DOUBLE AS q
  FROM (SELECT *, ceil((n + 1) * CAST({1.0 - alpha!r} AS DOUBLE)) AS k FROM (SELECT *, row_number() OVER ({part}ORDER BY score) AS rn,
    count(*) OVER ({part.strip()}) AS n FROM {source})) {group}"""


_PVALUE = f"""{_S}, {_BENIGN}, valued AS (SELECT p, (1 + (SELECT count(*) FROM benign WHERE score >= p)) / ((SELECT count(*) FROM benign) + 1) AS p_value, rows
  FROM (SELECT p, count(*) AS rows FROM scored_v WHERE split = 'test' GROUP BY 1) t)"""
_NAMES = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"


def _sets(q: str, source: str = "stage_probs_v") -> str:
    return f"""sets AS (SELECT vec_id, probs, CASE WHEN len(picked) > 0 THEN picked ELSE [({_NAMES})[list_position(probs, list_max(probs))]] END AS stages
  FROM (SELECT vec_id, probs, [({_NAMES})[i] FOR i IN range(1, 9) IF probs[i] >= greatest(0.0, 1.0 - {q})] AS picked FROM {source}) x)"""


_GATE = "('lateral_movement', 'command_and_control')"
_SPLIT = """CASE WHEN year(l_shipdate) <= 1997 THEN 'train' WHEN year(l_shipdate) = 1998 THEN 'validation'
  WHEN year(l_shipdate) = 1999 THEN 'calibration' ELSE 'test' END"""

ORACLE = {
    "decisions": f"{_S} SELECT split, label, count(*) AS rows, count(*) FILTER (p >= 0.7) AS hits FROM scored_v GROUP BY 1, 2",
    "binary_metrics": f"""{_S}, c AS (SELECT split, count(*) AS events, {_counts()} FROM scored_v GROUP BY 1)
        SELECT *, {_RATES} FROM c""",
    "extended_metrics": f"""{_S}, c AS (SELECT split, count(*) AS events, {_counts()},
          round(avg(-CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 6) AS log_loss
          FROM scored_v GROUP BY 1)
        SELECT *, {_RATES}, round((tp + tn) / events, 6) AS accuracy, round((tp + fn) / events, 6) AS prevalence,
          round(fn / nullif(tp + fn, 0), 6) AS false_negative_rate, round(tn / nullif(tn + fp, 0), 6) AS specificity,
          round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
          round(5 * tp / greatest(5 * tp + 4 * fn + fp, 1), 6) AS f2,
          round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
          tp + fp > 0 AS precision_defined, tp + fn > 0 AS recall_defined, tn + fp > 0 AS fpr_defined,
          {_wilson("tp", "(tp + fp)", "precision")}, {_wilson("tp", "(tp + fn)", "recall")}, {_wilson("fp", "(fp + tn)", "fpr")} FROM c""",
    "score_curve": f"{_S}, {_CURVE} SELECT * FROM curve",
    "rank_metrics": f"""{_S}, g AS (SELECT split, p, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM scored_v GROUP BY 1, 2),
        pairs AS (SELECT x.split, sum(x.a * y.b * CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0.0 END) AS wins
          FROM g x JOIN g y USING (split) GROUP BY 1),
        ap AS (SELECT x.split, sum(x.a * (SELECT sum(y.a) FROM g y WHERE y.split = x.split AND y.p >= x.p) /
          (SELECT sum(y.a + y.b) FROM g y WHERE y.split = x.split AND y.p >= x.p)) AS ap FROM g x GROUP BY 1),
        t AS (SELECT split, CAST(sum(a) AS BIGINT) AS positives, CAST(sum(b) AS BIGINT) AS negatives FROM g GROUP BY 1)
        SELECT split, positives, negatives, round(ap / nullif(positives, 0), 6) AS average_precision,
          round(CAST(wins AS DOUBLE) / nullif(positives * negatives, 0), 6) AS roc_auc FROM t JOIN pairs USING (split) JOIN ap USING (split)""",
    "threshold_choice": f"{_S}, {_CURVE} {_choice(0.2, 0.5, 0.0, 'loose')} UNION ALL {_choice(0.95, 0.001, 0.95, 'strict')}",
    "reliability_table": f"""{_S}, b AS (SELECT split, len([i FOR i IN range(1, 15) IF p >= i / 15.0::DOUBLE]) AS bin, label, p FROM scored_v),
        g AS (SELECT split, bin, count(*) AS "count", avg(label) AS a, avg(p) AS c FROM b GROUP BY 1, 2),
        grid AS (SELECT split, CAST(i AS INT) AS bin FROM (SELECT DISTINCT split FROM scored_v) s, (SELECT unnest(range(15)) AS i) r)
        SELECT split, bin, coalesce("count", 0) AS "count", round(coalesce(a, 0), 4) AS accuracy, round(coalesce(c, 0), 4) AS confidence,
          round(coalesce(abs(a - c), 0), 4) AS gap FROM grid LEFT JOIN g USING (split, bin)""",
    "calibration_error": f"""{_S}, b AS (SELECT split, label, p, len([i FOR i IN range(1, 10) IF p >= i / 10.0::DOUBLE]) AS b1,
          least(floor(p * 10), 9) AS b2 FROM scored_v),
        e1 AS (SELECT split, sum(n * g) / sum(n) AS e FROM (SELECT split, b1, count(*) AS n, abs(avg(label) - avg(p)) AS g FROM b GROUP BY 1, 2) GROUP BY 1),
        e2 AS (SELECT split, sum(n * g) / sum(n) AS e FROM (SELECT split, b2, count(*) AS n, abs(avg(label) - avg(p)) AS g FROM b GROUP BY 1, 2) GROUP BY 1)
        SELECT split, round(e1.e, 4) AS ece, e1.e < 0.05 AS well_calibrated, round(e2.e, 6) AS ece_floor FROM e1 JOIN e2 USING (split)""",
    "stage_confusion": f"{_S}, {_STAGE_GRID} SELECT split, stage, stage_pred, rows FROM conf",
    "stage_report": f"""{_S}, {_STAGE_GRID} SELECT stage, support, predicted_support, hits, round(hits / nullif(predicted_support, 0), 6) AS "precision",
        round(hits / nullif(support, 0), 6) AS recall, round(f1, 6) AS f1 FROM class_f1 WHERE split = 'test'""",
    "stage_summary": f"""{_S}, {_STAGE_GRID} SELECT split, CAST(sum(support) AS BIGINT) AS supervised_rows,
        round(avg(f1) FILTER (support > 0), 6) AS macro_f1_observed, round(avg(f1), 6) AS macro_f1_present,
        round(sum(hits) / nullif(sum(support), 0), 6) AS stage_accuracy FROM class_f1 GROUP BY 1""",
    "evaluation_report": f"{_S}, t AS (SELECT * FROM scored_v WHERE split = 'test'), {_REPORT.format(src='t')} SELECT *, {_RATES} FROM report",
    "target_check": f"""{_S}, t AS (SELECT * FROM scored_v WHERE split = 'test'), {_REPORT.format(src='t')}, {_CHECK.format(p=0.2, r=0.55, f=0.6)}
        SELECT capture, concat_ws(',', CASE WHEN f1 THEN 'precision' END, CASE WHEN f2 THEN 'recall' END,
          CASE WHEN f3 THEN 'false_positive_rate' END) AS failed, NOT (f1 OR f2 OR f3) AS met FROM failing""",
    "protocol_verdict": f"""{_S}, {_REPORT.format(src='scored_v')}, {_CHECK.format(p=0.2, r=0.4, f=0.6)}
        SELECT count(*) AS reports, count(*) FILTER (f1 OR f2 OR f3) AS failing, bool_and(NOT (f1 OR f2 OR f3)) AS all_met FROM failing""",
    "holdout_protocol": f"""{_S}, {_CURVE}, {_BENIGN}, th AS ({_choice(0.2, 0.5, 0.0, 'x')}), qq AS ({_quantile('benign', 0.1)})
        SELECT threshold, feasible, round(q, 6) AS q, count(*) AS events, {_counts('threshold')} FROM scored_v, th, qq WHERE split = 'test' GROUP BY 1, 2, 3""",
    "conformal_quantile": f"""{_S}, {_BENIGN} """
    + " UNION ALL ".join(f"SELECT *, {a}::DOUBLE AS alpha FROM ({_quantile('benign', a)})" for a in (0.01, 0.1, 0.5)),
    "conformal_quantile_by_capture": f"""{_S}, b AS (SELECT capture, p AS score FROM scored_v WHERE label = 0) {_quantile('b', 0.2, 'capture')}""",
    "stage_quantile": f"""{_PS}, s AS (SELECT 1 - probs[y + 1] AS score FROM stage_probs_v), x AS ({_quantile('s', 0.1)})
        SELECT n, rank, round(q, 6) AS q FROM x""",
    "p_values": f"{_PVALUE} SELECT p, round(p_value, 9) AS p_value, rows FROM valued",
    "conformal_verdicts": f"""{_PVALUE}, qq AS ({_quantile('benign', 0.2)})
        SELECT p, CASE WHEN NOT (p < q) AND NOT (p >= 1 - q) THEN CASE WHEN p >= 0.5 THEN 'attack' ELSE 'benign' END
          ELSE concat_ws(',', CASE WHEN p < q THEN 'benign' END, CASE WHEN p >= 1 - q THEN 'attack' END) END AS prediction_set,
          p_value <= 0.2 AS confirmed, p >= 0.7 AND p_value <= 0.2 AS high_risk, rows FROM valued, qq""",
    "stage_prediction_sets": f"""{_PS}, s AS (SELECT 1 - probs[y + 1] AS score FROM stage_probs_v), qq AS ({_quantile('s', 0.5)}),
        {_sets('q', 'stage_probs_v, (SELECT round(q, 9) AS q FROM qq) r')} SELECT vec_id, array_to_string(stages, ',') AS stages, CAST(len(stages) AS INT) AS set_size,
          len(stages) = 1 AS is_singleton, list_has_any(stages, ['lateral_movement', 'command_and_control', 'impact']) AS has_critical FROM sets""",
    "critical_set_algebra": f"""{_PS}, {_sets('0.85')} SELECT vec_id,
        array_to_string(list_sort([s FOR s IN stages IF s IN {_GATE}]), ',') AS inside,
        array_to_string(list_sort([s FOR s IN stages IF s NOT IN {_GATE}]), ',') AS outside,
        len([s FOR s IN stages IF s NOT IN {_GATE}]) = 0 AS subset FROM sets""",
    "feature_audit": f"""WITH r AS (SELECT {_SPLIT} AS split, CAST(year(l_shipdate) AS INT) AS capture, l_quantity, l_extendedprice, l_discount, p_retailprice
          FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT split, capture, count(*) AS rows, round(median(l_quantity), 6) AS median_l_quantity, round(median(l_extendedprice), 6) AS median_l_extendedprice,
          round(median(l_discount), 6) AS median_l_discount, count(*) FILTER (l_quantity > 0) AS eligible_unit_price,
          count(*) FILTER (l_quantity > 0 AND NOT abs(l_extendedprice / l_quantity - p_retailprice) <= 0.01 + 0.01 * abs(p_retailprice)) AS mismatches_unit_price
        FROM r GROUP BY 1, 2""",
    "label_conflicts": """WITH x AS (SELECT (l_quantity, l_discount, l_tax) AS vec, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
          CAST(year(l_shipdate) AS INT) AS capture FROM lineitem),
        o AS (SELECT vec, count(DISTINCT label) AS k FROM x GROUP BY 1), w AS (SELECT capture, vec, count(DISTINCT label) AS k FROM x GROUP BY 1, 2)
        SELECT CAST(NULL AS INT) AS capture, count(*) AS vectors, count(*) FILTER (k > 1) AS conflicting FROM o
        UNION ALL SELECT capture, count(*), count(*) FILTER (k > 1) FROM w GROUP BY 1""",
    "report_audit": f"""{_S} SELECT DISTINCT split, CASE WHEN split = 'test' THEN 'recall' ELSE '' END AS inconsistent, true AS chunks_match FROM scored_v""",
    "priority_sample": """WITH k AS (SELECT CAST(year(l_shipdate) AS INT) AS capture, l_returnflag, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key FROM lineitem)
        SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY capture, l_returnflag ORDER BY md5(row_key || '-42'), row_key) <= 512""",
    "families_absent_from_training": """WITH l AS (SELECT concat_ws('/', l_partkey, l_suppkey) AS family, year(l_shipdate) AS y FROM lineitem)
        SELECT family FROM l WHERE y = 1998 OR y >= 2000 EXCEPT SELECT family FROM l WHERE y <= 1997""",
    "train_validation_overlap": """SELECT l_orderkey AS order_key FROM lineitem WHERE year(l_shipdate) <= 1997
        INTERSECT SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) = 1998""",
}
