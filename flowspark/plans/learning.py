"""Models on Spark ML, their scores and comparison, and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import attribution, evaluate, learn
from flowspark.plans import views as v

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEAR = {"l_quantity": 0.02, "l_extendedprice": -0.00001, "l_discount": 3.0, "l_tax": 1.5}
BASELINE = {"l_quantity": 25.0, "l_extendedprice": 30000.0, "l_discount": 0.05, "l_tax": 0.04}


def _rows(spark, sf):
    line = v.table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        year.alias("capture"),
        F.when(year <= 1997, "train").when(year == 1998, "validation").when(year == 1999, "calibration").otherwise("test").alias("split"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") % 8).cast("int")).alias("stage"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("family"),
        *FEATURES,
    )


def logistic_baseline(spark, sf):
    """Fit on training rows, scored on validation rows."""
    rows = _rows(spark, sf)
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    model = learn.fit_logistic(learn.with_weights(train), FEATURES)
    return evaluate.binary_metrics(learn.score(held, model, FEATURES), 0.5, ["capture"])


def hidden_layer_baseline(spark, sf):
    rows = _rows(spark, sf)
    model = learn.fit_hidden(learn.with_weights(rows.where("split = 'train'")), FEATURES)
    return evaluate.binary_metrics(learn.score(rows.where("split = 'validation'"), model, FEATURES), 0.5, ["capture"])


def stage_classifier(spark, sf):
    rows = _rows(spark, sf)
    model = learn.fit_stage(rows.where("split = 'train'"), FEATURES)
    return evaluate.stage_report(learn.score_stage(rows.where("split = 'validation'"), model, FEATURES))


def controlled_comparison(spark, sf):
    """Three hidden-layer arms on the same validation rows, test is never read: the first half of the
    training captures, all of them, and all of them with family weights."""
    rows = _rows(spark, sf).where("split IN ('train', 'validation')")
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    train = train.withColumn("family", F.when(F.col("label") == 0, "benign").otherwise(F.col("family")))
    low, high = train.agg(F.min("capture"), F.max("capture")).first()
    arms = {"one_dataset": dict(among=F.col("capture") <= (low + high) // 2), "two_datasets": {}, "family_weights": dict(family="family")}
    for arm, how in arms.items():
        train = learn.with_arm_weight(train, arm, **how)
    fitted = learn.fit_hidden_arms(train, {arm: arm for arm in arms}, FEATURES)
    return learn.compare_arms({name: learn.score(held, model, FEATURES) for name, model in fitted.items()})


def holdout_modes(spark, sf):
    """Holdout report on test rows for two batch sizes, with and without resets."""
    line = v.table(spark, sf, "lineitem")
    key = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    year = F.year("l_shipdate")
    rows = line.select(
        *key,
        year.alias("capture"),
        F.when(year <= 1997, "train").when(year == 1998, "validation").when(year == 1999, "calibration").otherwise("test").alias("split"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.round(F.col("l_discount") * 100).cast("int") / F.lit(10.0)).alias("p"),
    )
    report = learn.run_protocol(rows, 0.1, (0.2, 0.4, 0.9), key, [32, 200], 2000)
    names = ["mode", "scope", "threshold", "feasible", "conformal_q", "events", "tp", "fp", "fn", "tn", "above_quantile"]
    return report.select(*names, F.array_join("failed", ",").alias("failed"), "met")


def shapley_attributions(spark, sf):
    """Every order line under a linear score, where the attributions are exact."""
    line = v.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES).alias("row_key"), *FEATURES
    )
    unique = line.dropDuplicates(["row_key"])
    rows = attribution.permutation_shapley(unique, "row_key", FEATURES, attribution.linear_score(LINEAR), BASELINE, 4)
    return rows.select("row_key", "feature", F.round("attribution", 9).alias("attribution"), F.round("prediction", 9).alias("prediction"))


def primary_drivers(spark, sf):
    """How often each feature is the main reason of the score."""
    line = v.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES).alias("row_key"), *FEATURES
    )
    rows = attribution.permutation_shapley(line.dropDuplicates(["row_key"]), "row_key", FEATURES, attribution.linear_score(LINEAR), BASELINE, 2)
    rounded = rows.withColumn("attribution", F.round("attribution", 9))
    top = attribution.top_attributions(rounded, "row_key")
    return top.groupBy("primary_driver").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.array_contains("top", "l_tax")).alias("tax_in_top3"))


def explanation_budget(spark, sf):
    flows = v.flows_v(spark, sf).withColumn("window", F.floor(F.col("last_us") / v.WINDOW))
    order = ["last_us", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    rows = attribution.explanation_budget(flows, ["window"], order, 5)
    return rows.groupBy("window").agg(F.count_if("explain").alias("explained"), F.count_if(~F.col("explain")).alias("exhausted"))


def best_capture(spark, sf):
    """Best capture per split by (recall, precision), the first one on ties."""
    rows = v.rounded(evaluate.binary_metrics(v.scored_v(spark, sf), 0.5, ["split", "capture"]), ["recall", "precision"])
    return evaluate.best_candidate(rows, "capture", ["recall", "precision"], ["split"])


QUERIES = {
    f.__name__: f
    for f in (
        logistic_baseline,
        hidden_layer_baseline,
        stage_classifier,
        controlled_comparison,
        holdout_modes,
        shapley_attributions,
        primary_drivers,
        explanation_budget,
        best_capture,
    )
}

_KEY = ", ".join(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES])
_ATTR = f"""lines AS (SELECT DISTINCT {_KEY} FROM lineitem),
named AS (SELECT *, concat_ws('-', {_KEY}) AS row_key, {" + ".join(f"{w} * {c}" for c, w in LINEAR.items())} AS prediction FROM lines),
attr AS ({" UNION ALL ".join(f"SELECT row_key, '{c}' AS feature, {w} * ({c} - {BASELINE[c]}) AS attribution, prediction FROM named" for c, w in LINEAR.items())})"""
_MODES = " UNION ALL ".join(f"SELECT 'batch_{s}_reset_{r}' AS mode, {s} AS size, {r} AS reset" for s in (32, 200) for r in (0, 2000))
ORACLE = {
    "holdout_modes": f"""WITH {v.SCORED}, lv AS (SELECT p, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM scored_v WHERE split = 'validation' GROUP BY 1),
        cv AS (SELECT p, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS pos, sum(b) OVER () AS neg FROM lv),
        ok AS (SELECT *, max(tp) OVER () AS best FROM cv WHERE tp > 0 AND tp / (tp + fp) >= 0.2 AND fp / neg <= 0.9 AND tp / pos >= 0.4),
        th AS (SELECT coalesce(max(p) FILTER (tp = best), 1.0)::DOUBLE AS threshold, count(p) > 0 AS feasible FROM ok),
        bn AS (SELECT p, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM scored_v WHERE split = 'calibration' AND label = 0),
        qq AS (SELECT coalesce(max(p) FILTER (rn = ceil((n + 1) * CAST(0.9 AS DOUBLE))), 1.0)::DOUBLE AS conformal_q FROM bn),
        lines AS (SELECT CAST(year(l_shipdate) AS INT) AS capture, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CAST(round(l_discount * 100) AS INT) / 10.0::DOUBLE AS p,
          row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS rn
          FROM lineitem WHERE year(l_shipdate) NOT IN (1998, 1999) AND year(l_shipdate) > 1997),
        modes AS ({_MODES}),
        t AS (SELECT mode, 'all' AS scope, label, p FROM lines, modes UNION ALL SELECT mode, 'capture ' || capture, label, p FROM lines, modes
          UNION ALL SELECT mode, 'cold', label, p FROM lines, modes WHERE CASE WHEN reset = 0 THEN rn ELSE rn % greatest(ceil(reset / size) * size, 1) END < size),
        c AS (SELECT mode, scope, threshold, feasible, conformal_q, count(*) AS events, count(*) FILTER (p >= threshold AND label = 1) AS tp,
          count(*) FILTER (p >= threshold AND label = 0) AS fp, count(*) FILTER (p < threshold AND label = 1) AS fn,
          count(*) FILTER (p < threshold AND label = 0) AS tn, count(*) FILTER (p > conformal_q) AS above_quantile FROM t, th, qq GROUP BY 1, 2, 3, 4, 5)
        SELECT c.*, concat_ws(',', CASE WHEN tp + fn > 0 AND (tp + fp = 0 OR tp / greatest(tp + fp, 1) < 0.2) THEN 'precision' END,
            CASE WHEN tp + fn > 0 AND tp / greatest(tp + fn, 1) < 0.4 THEN 'recall' END, CASE WHEN fp + tn > 0 AND fp / greatest(fp + tn, 1) > 0.9 THEN 'false_positive_rate' END) AS failed,
          NOT ((tp + fn > 0 AND (tp + fp = 0 OR tp / greatest(tp + fp, 1) < 0.2)) OR (tp + fn > 0 AND tp / greatest(tp + fn, 1) < 0.4)
            OR (fp + tn > 0 AND fp / greatest(fp + tn, 1) > 0.9)) AS met FROM c""",
    "shapley_attributions": f"WITH {_ATTR} SELECT row_key, feature, round(attribution, 9) AS attribution, round(prediction, 9) AS prediction FROM attr",
    "primary_drivers": f"""WITH {_ATTR}, r AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY -abs(round(attribution, 9)), feature) AS k FROM attr),
        g AS (SELECT row_key, max(feature) FILTER (k = 1) AS primary_driver, max(round(attribution, 9)) FILTER (k = 1) AS a, count(*) FILTER (k <= 3 AND feature = 'l_tax') AS tax FROM r GROUP BY 1)
        SELECT CASE WHEN a = 0 THEN 'No current-feature contribution' ELSE primary_driver END AS primary_driver, count(*) AS rows,
          CAST(sum(tax) AS BIGINT) AS tax_in_top3 FROM g GROUP BY 1""",
    "explanation_budget": f"""{v.FLOW_CTES}, c AS (SELECT last_us // {v.WINDOW} AS "window", count(*) AS n FROM flows_v GROUP BY 1)
        SELECT "window", least(n, 5) AS explained, greatest(n - 5, 0) AS exhausted FROM c""",
    "best_capture": f"""WITH {v.SCORED}, m AS (SELECT split, capture, count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp,
          count(*) FILTER (p < 0.5 AND label = 1) AS fn FROM scored_v GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(tp / greatest(tp + fn, 1), 6) DESC, round(tp / greatest(tp + fp, 1), 6) DESC, capture) AS k FROM m)
        SELECT split, capture AS best FROM r WHERE k = 1""",
}
