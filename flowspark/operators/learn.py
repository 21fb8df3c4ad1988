"""Baselines: weighted logistic and stage classifier on Spark ML, a weighted hidden layer, scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators import evaluate, prepare
from flowspark.schemas import STAGES
from flowspark.session import checkpointed, materialized

HIDDEN = 64
#: Rows whose hidden units stay in a core's cache; rows of a packed binary, so that a batch of binaries stays small.
CACHED, PACKED = 1024, 64


@dataclass
class Fitted:
    """A model with the scaler of its training rows (one row)."""

    scaler: DataFrame
    model: object


def scaled(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``x``: log features under the training scaler, whose deviation has a floor."""
    rows = prepare.apply_scaler(df, scaler, features)
    return rows.withColumn("x", F.array(*[f"scaled_{c}" for c in features])).drop(*[f"scaled_{c}" for c in features])


def _fit_scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """The dataset scaler of the rows, computed once."""
    return checkpointed(prepare.fit_scaler(train.withColumn("split", F.lit("train")), features))


def with_arm_weight(train: DataFrame, name: str, among: Column | None = None, family: str | None = None) -> DataFrame:
    """Add ``name``: the capped positive weight, times the family weight if asked for, as counted ``among``
    rows; NULL in other rows and in those without a family.

    The weights are counted once, however often the rows are read; as written tables they have a known size.
    """
    counted = train if among is None else train.where(among)
    positive = F.broadcast(materialized(prepare.binary_weight(counted).select("positive_weight"), "positive-weight"))  # one row
    weight = F.when(F.col("label") == 1, F.col("positive_weight")).otherwise(F.lit(1.0))
    rows = train.crossJoin(positive)
    if family is not None:
        per_family = materialized(prepare.family_weights(counted, family).select(F.col("family").alias(family), F.col("weight").alias("_family")), "family-weights")
        rows, weight = rows.join(per_family, family, "left"), weight * F.col("_family")
    return rows.withColumn(name, weight if among is None else F.when(among, weight)).drop("positive_weight", "_family")


def with_weights(train: DataFrame, family: str | None = None) -> DataFrame:
    """Add ``weight``: the capped positive weight, times the family weight if asked for."""
    rows = with_arm_weight(train, "weight", family=family)
    return rows if family is None else rows.where("weight IS NOT NULL")


def fit_logistic(train: DataFrame, features: list[str], iterations: int = 30) -> Fitted:
    """Weighted logistic regression on scaled log features (``label``, ``weight``)."""
    lr = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1e-4, standardization=False)
    scaler = _fit_scaler(train, features)
    return Fitted(scaler, lr.fit(scaled(train, scaler, features).withColumn("vector", array_to_vector("x"))))


def fit_stage(train: DataFrame, features: list[str], iterations: int = 30) -> Fitted:
    """Multinomial stage classifier over rows whose stage is known, capped class weights."""
    known = train.where("stage IS NOT NULL")
    weights = prepare.stage_weights(known).select("stage", F.col("weight").alias("stage_weight"))
    rows = known.join(F.broadcast(weights), "stage").withColumn("stage_label", F.col("stage").cast("double"))  # eight rows
    lr = LogisticRegression(
        featuresCol="vector", labelCol="stage_label", weightCol="stage_weight", family="multinomial", maxIter=iterations, regParam=1e-4,
        standardization=False, probabilityCol="stage_probability", predictionCol="stage_prediction", rawPredictionCol="stage_raw",
    )
    scaler = _fit_scaler(known, features)
    return Fitted(scaler, lr.fit(scaled(rows, scaler, features).withColumn("vector", array_to_vector("x"))))


@dataclass
class HiddenLayer:
    """tanh units between the inputs and one logistic output."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> HiddenLayer:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w1.ravel(), self.b1, self.w2, [self.b2]])

    def moved(self, flat: np.ndarray) -> HiddenLayer:
        a, h = self.w1.size, len(self.b1)
        return HiddenLayer(flat[:a].reshape(self.w1.shape), flat[a : a + h], flat[a + h : a + 2 * h], float(flat[-1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2, -50, 50)))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
        """Of the weighted logistic loss summed over the rows, with the sum of weights at its end; inputs are
        scaled first if ``mean`` and ``scale`` are given."""
        into = np.vstack([self.w1, self.b1])
        inner, outer, sums = np.zeros(into.shape), np.zeros(len(self.w2)), np.zeros(2)
        units = np.empty((min(CACHED, len(y)), len(self.w2)))
        for at in range(0, len(y), CACHED):
            some = slice(at, at + CACHED)
            # One row an input: long inner loops.
            inputs = np.ones((len(into), len(y[some])))
            inputs[:-1] = x[some].T
            if mean is not None:
                inputs[:-1] = (inputs[:-1] - mean[:, None]) / scale[:, None]
            unit = units[: inputs.shape[1]]
            np.tanh(np.matmul(inputs.T, into, out=unit), out=unit)
            error = weight[some] * (1 / (1 + np.exp(-np.clip(unit @ self.w2 + self.b2, -50, 50))) - y[some])
            outer += error @ unit
            np.subtract(1, np.multiply(unit, unit, out=unit), out=unit)
            inner += (inputs * error) @ unit
            sums += error.sum(), weight[some].sum()
        return np.concatenate([(inner * self.w2).ravel(), outer, sums])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doubles as binaries of ``PACKED`` rows each: their numbers one row after the other, NaN for NULL."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.column_stack([np.asarray(column, np.float64) for column in batch.columns])
        ends = np.minimum(np.arange(0, len(numbers) + PACKED, PACKED), len(numbers)) * numbers.strides[0]
        rows = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])
        yield pa.RecordBatch.from_arrays([rows], ["rows"])


def _unpacked(rows: pa.Array, width: int) -> np.ndarray:
    """The numbers of packed rows, which lie one after the other whatever the binaries they are cut into."""
    _, ends, data = rows.buffers()
    ends = np.frombuffer(ends, np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, width)


def fit_hidden_arms(
    train: DataFrame, weights: dict[str, str], features: list[str], hidden: int = HIDDEN, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, seed: int = 42
) -> dict[str, Fitted]:
    """Per arm one hidden layer by Adam on the whole weighted gradient of its own rows: those whose weight, the
    column that ``weights`` names, is not NULL.

    Every epoch is one pass for all arms over the logged features, which are packed once: tasks scale the rows of
    each arm and sum their gradients, the partial sums are added up by position, and as many numbers as the
    layers have reach the driver.
    """
    scalers = {arm: _fit_scaler(train.where(F.col(weight).isNotNull()), features) for arm, weight in weights.items()}
    scales = [[np.array([row[f"{k}_{c}"] for c in features], np.float64) for k in ("mean", "scale")] for row in (scaler.first() for scaler in scalers.values())]
    columns = [*[F.log1p(c) for c in features], "label", *weights.values()]
    numbers = train.select([(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    packed = materialized(numbers.mapInArrow(_packed, "rows binary"), "hidden-rows")
    layers = [HiddenLayer.fresh(len(features), hidden, seed) for _ in weights]
    size, known, width = len(layers[0].flat()), len(features), len(columns)
    first, second = np.zeros((len(layers), size)), np.zeros((len(layers), size))
    for epoch in range(1, epochs + 1):

        def partial(batches, layers=tuple(layers)):
            total = np.zeros((len(layers), size + 1))
            for batch in batches:
                every = _unpacked(batch.column("rows"), width)
                for at in range(0, len(every), 16 * CACHED):
                    some = every[at : at + 16 * CACHED]
                    for arm, (layer, (mean, scale)) in enumerate(zip(layers, scales)):
                        inside = ~np.isnan(some[:, known + 1 + arm])
                        own = some if inside.all() else some[inside]
                        total[arm] += layer.gradient(own[:, :known], own[:, known], own[:, known + 1 + arm], mean, scale)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "g"])

        sums = packed.mapInArrow(partial, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).toArrow()
        summed = np.zeros((len(layers), size + 1))
        summed.ravel()[sums.column("k").to_numpy()] = sums.column("g").to_numpy()
        flat = np.stack([layer.flat() for layer in layers])
        g = summed[:, :-1] / np.maximum(summed[:, -1:], 1e-12) + decay * flat
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        layers = [layer.moved(moved) for layer, moved in zip(layers, flat - step)]
    return {arm: Fitted(scalers[arm], layer) for arm, layer in zip(weights, layers)}


def fit_hidden(train: DataFrame, features: list[str], hidden: int = HIDDEN, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, seed: int = 42) -> Fitted:
    """:func:`fit_hidden_arms` of the rows with a ``weight``."""
    return fit_hidden_arms(train, {"only": "weight"}, features, hidden, epochs, rate, decay, seed)["only"]


def score(df: DataFrame, fitted: Fitted, features: list[str]) -> DataFrame:
    """Add the attack probability ``p``."""
    if not isinstance(fitted.model, HiddenLayer):
        out = fitted.model.transform(scaled(df, fitted.scaler, features).withColumn("vector", array_to_vector("x")))
        return out.select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    layer = fitted.model

    @F.pandas_udf("double")
    def probability(*x: pd.Series) -> pd.Series:
        return pd.Series(layer.probability(np.column_stack(x)), dtype="float64")

    return prepare.apply_scaler(df, fitted.scaler, features).select(*df.columns, probability(*[f"scaled_{c}" for c in features]).alias("p"))


def score_stage(df: DataFrame, fitted: Fitted, features: list[str]) -> DataFrame:
    """Add ``probs``, padded to all stages, and ``stage_pred``."""
    out = fitted.model.transform(scaled(df, fitted.scaler, features).withColumn("vector", array_to_vector("x")))
    found = vector_to_array("stage_probability")
    padded = F.transform(F.sequence(F.lit(0), F.lit(len(STAGES) - 1)), lambda i: F.coalesce(F.get(found, i), F.lit(0.0)))
    return out.select(*df.columns, padded.alias("probs"), F.col("stage_prediction").cast("int").alias("stage_pred"))


def compare_arms(arms: dict[str, DataFrame], threshold: float = 0.5, test_split: str = "test") -> DataFrame:
    """Evaluation report and ranking metrics of scored arms side by side, per capture and overall.

    All arms must hold the same validation rows; the test split is refused.
    """
    parts = [df.select(F.lit(name).alias("arm"), "split", "capture", "label", "p") for name, df in arms.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    guarded = rows.where(F.when(F.col("split") == test_split, F.raise_error(F.lit("test rows in a comparison")).cast("boolean")).otherwise(True))
    both = F.explode(F.array(F.col("capture").cast("string"), F.lit("all")))
    # The reports go over the rows several times; they are scored once.
    scored = materialized(guarded.select("arm", F.col("capture").cast("string").alias("capture"), "label", "p"), "scored-arms")
    tagged = scored.select("arm", both.alias("scope"), "label", "p")
    counts = evaluate.binary_metrics(tagged, threshold, ["arm", "scope"])
    return counts.join(evaluate.rank_metrics(tagged, ["arm", "scope"]).drop("positives", "negatives"), ["arm", "scope"])


def run_protocol(
    rows: DataFrame, alpha: float, targets: tuple[float, float, float], order: list[str], sizes: list[int], reset: int
) -> DataFrame:
    """Holdout protocol over scored rows: the threshold comes from validation, the quantile
    from benign calibration rows, and the report covers test rows only, for every batch
    size and with or without history resets; ``cold`` rows are reported apart.
    """
    from flowspark.operators.calibrate import conformal_q
    from flowspark.operators.graph import batch_ordinals, cold_start

    precision, recall, fpr = targets
    point = evaluate.choose_threshold(rows.where("split = 'validation'"), precision, fpr, recall)
    benign = rows.where("split = 'calibration' AND label = 0").select(F.col("p").alias("score"))
    point = point.crossJoin(conformal_q(benign, alpha).select(F.col("q").alias("conformal_q")))  # one row each
    test = rows.where("split = 'test'")
    modes = [(size, window) for size in sizes for window in (0, reset)]
    parts = []
    for size, window in modes:
        batched = cold_start(batch_ordinals(test, ["capture"], order, size, window), "after_reset", ["capture"], window, size)
        parts.append(batched.select(F.lit(f"batch_{size}_reset_{window}").alias("mode"), "capture", "label", "p", "cold"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    scopes = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("capture "), F.col("capture").cast("string")), F.when(F.col("cold"), "cold")))
    tagged = every.select("mode", F.explode(scopes).alias("scope"), "label", "p").crossJoin(F.broadcast(point))
    counted = tagged.groupBy("mode", "scope", "threshold", "feasible", "conformal_q").agg(
        F.count(F.lit(1)).alias("events"), *evaluate.confusion(F.col("threshold")), F.count_if(F.col("p") > F.col("conformal_q")).alias("above_quantile")
    )
    return evaluate.target_check(evaluate._ratios(counted), precision, recall, fpr)
