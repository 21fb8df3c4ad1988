"""Evaluation and calibration against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import attribution, audit, calibrate, evaluate, graph, prepare


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, p double")


@pytest.mark.parametrize("limit", [3, 10_000])
def test_rank_metrics_and_threshold(spark, limit):
    rng = random.Random(5)
    pairs = [(int(rng.random() < 0.3), rng.randint(0, 20) / 20) for _ in range(300)]
    df = _scored(spark, pairs)
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    levels = sorted({p for _, p in pairs}, reverse=True)
    hits = {t: (sum(p >= t for p in pos), sum(p >= t for p in neg)) for t in levels}
    ap, before = 0.0, 0
    for t in levels:
        tp, fp = hits[t]
        ap += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    r = evaluate.rank_metrics(df, limit=limit).first()
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    fits = [(tp, t) for t, (tp, fp) in hits.items() if tp and tp / (tp + fp) >= 0.3 and fp / len(neg) <= 0.5]
    choice = evaluate.choose_threshold(df, 0.3, 0.5, limit=limit).first()
    assert (choice.threshold, choice.feasible) == (max(fits)[1], True)


def test_all_tied(spark):
    df = _scored(spark, [(0, 0.5), (1, 0.5)])
    r = evaluate.rank_metrics(df).first()
    assert (r.roc_auc, r.average_precision) == (0.5, 0.5)
    assert tuple(evaluate.choose_threshold(df, 0.9, 1.0).first()) == (1.0, False)
    assert evaluate.rank_metrics(_scored(spark, [(0, 0.1), (0, 0.4)])).first().roc_auc is None


def test_last_bin_closed(spark):
    df = _scored(spark, [(0, 1.0)])
    assert evaluate.ece(df).first().ece == 1.0
    assert [r["count"] for r in evaluate.reliability(df).orderBy("bin").collect()] == [0] * 9 + [1]
    assert evaluate.ece(df, rule="floor").first().ece == 1.0


def test_one_bad_capture_fails_the_protocol(spark):
    good = [("a", 1, 0.9)] * 99 + [("a", 0, 0.1)] * 100
    bad = [("b", 1, 0.1), ("b", 0, 0.1)]
    rows = spark.createDataFrame(good + bad, "capture string, label int, p double")
    checked = evaluate.target_check(evaluate.evaluation_report(rows, 0.5), 0.95, 0.95, 0.001)
    got = {r.capture: (r.met, r.failed) for r in checked.collect()}
    assert got[None][0] and got["a"][0] and got["b"] == (False, ["precision", "recall"])
    assert not evaluate.protocol_verdict(checked).first().all_met


def _benign(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "score double")


@pytest.mark.parametrize("limit", [2, 10_000])
def test_conformal_quantile(spark, limit):
    rng = random.Random(2)
    scores = [rng.randint(0, 9) / 10 for _ in range(57)]
    for alpha in (0.01, 0.1, 0.33):
        k = math.ceil((len(scores) + 1) * (1 - alpha))
        expected = sorted(scores)[k - 1] if k <= len(scores) else 1.0
        assert calibrate.conformal_q(_benign(spark, scores), alpha, limit=limit).first().q == expected
    asked = spark.createDataFrame([(i / 10,) for i in range(11)], "p double")
    for r in calibrate.p_value(asked, _benign(spark, scores), limit).collect():
        assert r.p_value == pytest.approx((1 + sum(s >= r.p for s in scores)) / 58)


def test_conformal_verdicts(spark):
    one = spark.createDataFrame([(0.5,)], "p double")
    small = calibrate.conformal_verdict(one, _benign(spark, [0.5]), 0.1).first()
    assert small.q_hat == 1.0 and small.prediction_set == ["benign", "attack"]
    rows = spark.createDataFrame([(0.9,), (0.99,)], "p double")
    got = {r.p: r.confirmed for r in calibrate.conformal_verdict(rows, _benign(spark, [0.9] * 100), 0.05).collect()}
    assert got == {0.9: False, 0.99: True}
    empty = calibrate.conformal_verdict(rows, _benign(spark, []), 0.05).collect()
    assert all(r.p_value == 1.0 and not r.confirmed and r.high_risk for r in empty)


def test_stage_sets(spark):
    rows = spark.createDataFrame([([0.5, 0.3, 0.2] + [0.0] * 5,)], "probs array<double>")
    assert calibrate.stage_sets(rows).first().set_size == 8
    assert calibrate.stage_sets(rows, F.lit(0.75)).first().stage_set == ["benign", "reconnaissance"]
    assert calibrate.stage_sets(rows, F.lit(0.1)).first().stage_set == ["benign"]
    bad = spark.createDataFrame([(0, [0.5, 0.2])], "y int, probs array<double>")
    with pytest.raises(Exception, match="probability_sum"):
        calibrate.conformal_q_multi(bad, 0.1).collect()


def test_linear_attributions(spark):
    rows = spark.createDataFrame([(1, 3.0, 3.0, 5.0)], "id int, a double, b double, c double")
    got = attribution.permutation_shapley(rows, "id", ["a", "b", "c"], attribution.linear_score(dict(a=2, b=-3, c=0)), dict(a=0, b=0, c=0), 8)
    assert {r.feature: r.attribution for r in got.collect()} == {"a": 6.0, "b": -9.0, "c": 0.0}
    assert attribution.additivity_residual(got, "id").first().residual == 0
    top = attribution.top_attributions(got, "id").first()
    assert top.top == ["b", "a", "c"] and top.primary_driver == "b"
    with pytest.raises(ValueError):
        attribution.permutation_shapley(rows, "id", ["a"], attribution.linear_score({}), dict(a=0), 1)


def test_leaks_and_duplicates(spark):
    rows = spark.createDataFrame(
        [("x", "train", 1, None, 1), ("x", "train", 1, None, 2), ("y", "train", 0, 0, 3), ("y", "test", 0, 0, 4), ("z", "test", 0, 0, 5), ("z", "test", 1, 1, 6)],
        "fingerprint string, split string, attack int, stage int, n int",
    )
    got = {r.fingerprint: r.crosses_splits for r in prepare.find_leaks(rows).collect()}
    assert got == {"y": True, "z": False}
    assert sorted(r.n for r in prepare.dedupe_events(rows, ["n"]).collect()) == [1, 3, 5]


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).alias("hot"), "id").repartition(7)
    first = {r.id for r in audit.priority_sample(rows, ["hot"], ["id"], 20, 42).collect()}
    again = {r.id for r in audit.priority_sample(rows.coalesce(1), ["hot"], ["id"], 20, 42).collect()}
    assert len(first) == 40 and first == again


def test_batches_and_cold_start(spark):
    rows = spark.createDataFrame([("c", i, f"h{i % 3}", f"h{i // 4}", 1, 2) for i in range(23)], "capture string, n int, src_ip string, dst_ip string, src_port int, dst_port int")
    for limit in (4, 1000):
        got = graph.batch_ordinals(rows, ["capture"], ["n"], 5, 8, limit).orderBy("n").collect()
        assert [r.batch for r in got] == [i // 5 for i in range(23)]
        assert [r.epoch for r in got] == [i // 10 for i in range(23)]
    cold = graph.cold_start(graph.batch_ordinals(rows, ["capture"], ["n"], 5, 8), "after_reset", ["capture"], 8, 5)
    assert {r.batch for r in cold.where("cold").collect()} == {0, 2, 4}
