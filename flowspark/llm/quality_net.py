"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Each word bucket has a sparse random index vector (a few +1 and -1).  Its word vector is that plus
the direction of the summed index vectors of its neighbours in the sampled texts.  A document is
the mean of its tokens' vectors with shares of capitals, immediate repeats, signs and digits, its
length and the mean's norm.  A tanh layer and a sigmoid are trained by Adam; on a part of the
sample that training does not see, one temperature is fitted to calibrate the probabilities.

Fitting uses at most ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_BYTES`` bytes; scoring
reads every whole text in one pass and sends workers a model of fixed size.

Defined cases: null text is empty and is scored like one; a repeated row gets a row each; without
labelled texts of both classes every score is the labelled share of class 1 (0.5 without labels);
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.bytetext import chunks, text_bytes, tokens
from flowspark.llm.labelled import sample

BUCKET_BITS, SIZE, NONZERO, HIDDEN = 15, 64, 4, 32
REACH = 2
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32_768
EPOCHS, BATCH, RATE, DECAY = 40, 128, 3e-3, 1e-4
PIECE = 1 << 18


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero entries."""
    rng = np.random.default_rng(11)
    return rng.integers(0, SIZE, (1 << BUCKET_BITS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (1 << BUCKET_BITS, NONZERO))


def _dense(places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), SIZE))
    np.add.at(out, (np.arange(len(places))[:, None], places), signs)
    return out


def word_vectors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Vectors of all buckets, from the neighbours of their words in these texts."""
    places, signs = _index_vectors()
    context = np.zeros((1 << BUCKET_BITS) * SIZE)
    for a, b in chunks(starts, 1 << 20):
        row, _, _, h = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        for gap in range(1, REACH + 1):
            near = row[gap:] == row[:-gap]
            left, right = bucket[:-gap][near], bucket[gap:][near]
            for word, other in ((left, right), (right, left)):
                context += np.bincount((word[:, None] * SIZE + places[other]).ravel(), signs[other].ravel(), minlength=len(context))
    context = context.reshape(-1, SIZE)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(_dense(places, signs)) + unit(context)).astype(np.float32)


def features(data: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text."""
    rows = len(starts) - 1
    out = np.zeros((rows, SIZE + 6))
    for a, b in chunks(starts, PIECE):
        row, kind, upper, h = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        n = np.bincount(row, minlength=b - a).astype(float)
        whole = np.maximum(n, 1)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            out[a:b, :SIZE][row[first]] = np.add.reduceat(vectors[bucket], first, axis=0)
        words = kind == 1
        wrow, wh = row[words], h[words]
        again = np.concatenate([[False], (wh[1:] == wh[:-1]) & (wrow[1:] == wrow[:-1])]) if len(wh) else np.zeros(0, bool)
        count = lambda r: np.bincount(r, minlength=b - a)
        out[a:b] /= whole[:, None]
        for i, share in enumerate([count(row[upper]), count(wrow[again]), count(row[kind == 3]), count(row[kind == 2])]):
            out[a:b, SIZE + i] = share / whole
        out[a:b, SIZE + 4] = np.log1p(n)
        out[a:b, SIZE + 5] = np.linalg.norm(out[a:b, :SIZE], axis=1)
    return out


@dataclass
class Model:
    """All that scoring needs; ``share`` answers alone where nothing could be learned."""

    vectors: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    layers: list[np.ndarray] | None
    temperature: float
    share: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(starts) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(features(data, starts, self.vectors)) / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            xs, ys = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            hidden = np.tanh(xs @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30))) - ys) / len(ys)
            back = error[:, None] * layers[2] * (1 - hidden**2)
            step += 1
            for i, g in enumerate([xs.T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], error.sum()]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit(data: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    apart = np.arange(len(y)) % 5 == 4  # calibration part
    if len(set(y[~apart])) < 2:
        return Model(None, None, None, None, 1.0, share)
    vectors = word_vectors(data, starts)
    x = features(data, starts, vectors)
    mean, scale = x[~apart].mean(0), x[~apart].std(0) + 1e-6
    model = Model(vectors, mean, scale, _train((x[~apart] - mean) / scale, y[~apart]), 1.0, share)
    if apart.any():
        z = model.logits(x[apart])
        loss = lambda t: np.logaddexp(0, np.where(y[apart] > 0, -z, z) / t).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def scored(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score`` for every row; the model has a ``scores(bytes, starts)`` of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(data, starts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, usable: Column, *, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, score``: learned from labels where ``usable`` holds, for every document."""
    return scored(docs, fit(*sample(docs, labels, "quality", usable, rows=rows, longest=longest)))
