"""Learners against plain numpy on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import learn

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 50, 400), rng.uniform(0, 5, 400)
    y = ((a > 25) ^ (b > 2.5)).astype(int)
    data = [(i, float(a[i]), float(b[i]), 3.0, int(y[i]), "x" if i % 3 else "y") for i in range(400)]
    return spark.createDataFrame(data, "id int, a double, b double, flat double, label int, family string").repartition(3)


def _scaled(frame, names):
    logs = np.log1p(frame[names].to_numpy())
    return (logs - logs.mean(0)) / np.maximum(logs.std(0), 1e-3)


def test_hidden_layer_takes_the_steps_of_plain_numpy(rows):
    weighted = learn.with_weights(rows)
    fitted = learn.fit_hidden(weighted, FEATURES, hidden=5, epochs=6, seed=7)
    frame = weighted.toPandas()
    x, y, w = _scaled(frame, FEATURES), frame["label"].to_numpy(float), frame["weight"].to_numpy()
    rng = np.random.default_rng(7)
    w1, w2 = rng.normal(0, 2**-0.5, (2, 5)), rng.normal(0, 5**-0.5, 5)
    b1, b2 = np.zeros(5), 0.0
    moments = [np.zeros(21), np.zeros(21)]
    for t in range(1, 7):
        grads = np.zeros(21)
        for xi, yi, wi in zip(x, y, w):  # row by row
            u = np.tanh(xi @ w1 + b1)
            e = wi * (1 / (1 + np.exp(-(u @ w2 + b2))) - yi)
            back = e * w2 * (1 - u**2)
            grads += np.concatenate([np.outer(xi, back).ravel(), back, e * u, [e]])
        flat = np.concatenate([w1.ravel(), b1, w2, [b2]])
        g = grads / w.sum() + 1e-4 * flat
        moments = [0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g]
        flat = flat - 0.05 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w1, b1, w2, b2 = flat[:10].reshape(2, 5), flat[10:15], flat[15:20], flat[20]
    assert fitted.model.flat() == pytest.approx(np.concatenate([w1.ravel(), b1, w2, [b2]]), rel=1e-7)
    got = {r.id: r.p for r in learn.score(rows, fitted, FEATURES).collect()}
    p = 1 / (1 + np.exp(-(np.tanh(x @ w1 + b1) @ w2 + b2)))
    assert [got[i] for i in frame["id"]] == pytest.approx(p.tolist(), rel=1e-7)


def test_hidden_layer_learns_what_a_line_cannot(rows):
    weighted = learn.with_weights(rows)
    right = lambda f: learn.score(rows, f, FEATURES).agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right(learn.fit_hidden(weighted, FEATURES, hidden=16, epochs=120)) > 0.85 > right(learn.fit_logistic(weighted, FEATURES))


def test_scaler_has_a_floor(rows):
    fitted = learn.fit_logistic(learn.with_weights(rows), ["a", "flat"])
    scaler = fitted.scaler.first()
    assert scaler.scale_flat == 1e-3 and scaler.mean_flat == pytest.approx(np.log(4))
    frame = rows.toPandas()
    assert scaler.scale_a == pytest.approx(np.log1p(frame["a"]).std(ddof=0))


def test_arms_refuse_test_rows(rows):
    held = rows.withColumn("split", F.when(F.col("id") == 3, "test").otherwise("validation")).withColumns({"capture": F.lit(1), "p": F.lit(0.5)})
    with pytest.raises(Exception, match="test rows"):
        learn.compare_arms({"one": held}).collect()


def test_arms_fitted_together_are_those_fitted_alone(rows):
    """Of rows that fill neither a packed binary nor a cached block; a row without a family is no row of its arm."""
    rows = rows.withColumn("family", F.when(F.col("id") != 9, F.col("family")))
    few = F.col("id") < 70
    shared = learn.with_arm_weight(learn.with_arm_weight(learn.with_arm_weight(rows, "few", few), "all"), "families", family="family")
    assert shared.count() == 400
    together = learn.fit_hidden_arms(shared, {"few": "few", "all": "all", "families": "families"}, FEATURES, hidden=5, epochs=4)
    alone = {"few": learn.with_weights(rows.where(few)), "all": learn.with_weights(rows), "families": learn.with_weights(rows, "family")}
    assert alone["families"].count() == 399
    for name, part in alone.items():
        fitted = learn.fit_hidden(part, FEATURES, hidden=5, epochs=4)
        assert together[name].model.flat() == pytest.approx(fitted.model.flat(), rel=1e-9, abs=1e-12)
        assert tuple(together[name].scaler.first()) == pytest.approx(tuple(fitted.scaler.first()), rel=1e-12)


@pytest.mark.parametrize("count", [1, 63, 64, 65, 513, 1100])
def test_gradient_by_blocks_of_packed_rows(count):
    import pyarrow as pa

    rng = np.random.default_rng(count)
    x, y, w = rng.normal(size=(count, 3)), rng.integers(0, 2, count).astype(float), rng.uniform(0.5, 2, count)
    batch = pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(x.T)), pa.array(y), pa.array(w)], list("abcyw"))
    (packed,) = learn._packed([batch])
    assert packed.num_rows == -(-count // learn.PACKED)
    numbers = learn._unpacked(packed.column("rows"), 5)
    assert (numbers == np.column_stack([x, y, w])).all()
    assert (learn._unpacked(packed.column("rows").slice(1), 5) == numbers[learn.PACKED :]).all()
    layer = learn.HiddenLayer.fresh(3, 7, 0)
    u = np.tanh(x @ layer.w1 + layer.b1)
    e = w * (1 / (1 + np.exp(-(u @ layer.w2 + layer.b2))) - y)
    back = e[:, None] * layer.w2 * (1 - u * u)
    want = np.concatenate([(x.T @ back).ravel(), back.sum(0), u.T @ e, [e.sum(), w.sum()]])
    assert layer.gradient(numbers[:, :3], numbers[:, 3], numbers[:, 4]) == pytest.approx(want, rel=1e-9, abs=1e-11)
