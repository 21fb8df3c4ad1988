"""Hard negatives by inner product, with bounds along a spanning tree of anchors.

Anchors are taken in blocks of a set size, each against all rows.  Over the anchors of a block lies
the minimum spanning tree of their distances.  With the score of a parent anchor known to be in
[lo, hi], a child's score with candidate c is in [lo - d |c|, hi + d |c|], d being the length of the
tree's edge: only candidates whose interval meets a window of the child are scored, and they get
the interval of that one score.  A window is the range a search still asks for: the given range, cut
below by the worst of the best scores met so far.  Only the root is scored with every candidate.

Two searches make a block: the positives (same label, no range), then the negatives (other labels,
a range for each positive).  Tasks return the best of their rows, so no label, however frequent,
is gathered.  A block's anchors and positives pass through the driver: at most ``block`` of them.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take
no part; exact repeats of a row count once, different rows under one id count each; shorter vectors
are padded with zeros; equal scores go by the smaller id; scores beyond 64 bits wrap as longs do;
extra columns are left out; no anchors, no positives or an empty table give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import fresh_dir, materialized

#: Candidates that are held against a block at once.
PIECE = 2048
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``order, parent, length`` of the minimum spanning tree, parents before children; the first is the root."""
    n = len(vectors)
    squares = (vectors * vectors).sum(1)
    order, parent, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, owner, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k], open_[now] = now, False
        gap = squares + squares[now] - 2 * (vectors @ vectors[now])
        closer = open_ & (gap < near)
        near[closer], owner[closer] = gap[closer], now
        if k + 1 < n:
            now = int(np.argmin(np.where(open_, near, np.inf)))
            parent[now] = owner[now]
            # The edge itself, not the difference of large squares, bounds the scores.
            length[now] = np.linalg.norm(vectors[now] - vectors[parent[now]])
    return order, parent, length


class Search:
    """The best ``k`` candidates of each window of a block's anchors, over batches of rows."""

    def __init__(self, block: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.block, self.low, self.high, self.k, self.same = block, low, high, k, same
        self.scores = np.full((*low.shape, k), _LOW, np.int64)
        self.ids = np.full((*low.shape, k), _HIGH, np.int64)
        self.filled = np.zeros(low.shape, np.int64)
        self.scored = self.met = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        anchors, order, parent, length = (self.block[x] for x in ("vectors", "order", "parent", "length"))
        norms = np.sqrt((vectors * vectors).sum(1))
        exact = norms.max(initial=0) * self.block["norm"] < EXACT
        lo, hi = np.empty((len(anchors), len(ids))), np.empty((len(anchors), len(ids)))
        whole = vectors.astype(np.int64) if not exact else None
        for step, a in enumerate(order.tolist()):
            slack = length[a] * norms * (1 + 1e-9) + 1e-6
            if step == 0 or not exact:
                at = np.arange(len(ids))
            else:
                lo[a], hi[a] = lo[parent[a]] - slack, hi[parent[a]] + slack
                floor, ceiling = self._open(a)
                at = np.flatnonzero((hi[a] >= floor) & (lo[a] <= ceiling) & ((labels == self.block["labels"][a]) == self.same))
            self.scored += len(at)
            self.met += len(ids)
            if not len(at):
                continue
            if exact:
                score = vectors[at] @ anchors[a]
                lo[a, at] = hi[a, at] = score
                score = score.astype(np.int64)
            else:
                with np.errstate(over="ignore"):
                    score = whole @ anchors[a].astype(np.int64)
            self._take(a, at, score, ids, labels, vectors)

    def _open(self, a: int) -> tuple[float, float]:
        """The range that some window of the anchor still asks for."""
        asked = self.low[a] <= self.high[a]
        if not asked.any():
            return np.inf, -np.inf
        floor = np.maximum(self.low[a], np.where(self.filled[a] == self.k, self.scores[a, :, -1], _LOW))
        return float(floor[asked].min()), float(self.high[a][asked].max())

    def _take(self, a: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        fits = (labels[at] == self.block["labels"][a]) == self.same
        if self.same:
            own = np.flatnonzero(ids[at] == self.block["ids"][a])
            fits[own[(vectors[at[own]] == self.block["vectors"][a]).all(1)]] = False
        at, score = at[fits], score[fits]
        for w in range(self.low.shape[1]):
            floor = max(int(self.low[a, w]), int(self.scores[a, w, -1]) if self.filled[a, w] == self.k else _LOW)
            here = np.flatnonzero((score >= floor) & (score <= self.high[a, w]))
            if not len(here):
                continue
            if len(here) > self.k:
                edge = np.partition(score[here], len(here) - self.k)[len(here) - self.k]
                here = here[score[here] >= edge]
            held = self.filled[a, w]
            scores = np.concatenate([self.scores[a, w, :held], score[here]])
            found = np.concatenate([self.ids[a, w, :held], ids[at[here]]])
            best = np.lexsort((found, -scores))[: self.k]
            self.filled[a, w] = len(best)
            self.scores[a, w, : len(best)], self.ids[a, w, : len(best)] = scores[best], found[best]

    def best(self) -> pa.RecordBatch:
        a, w, k = np.nonzero(np.arange(self.k) < self.filled[:, :, None])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, w, self.ids[a, w, k], self.scores[a, w, k])], ["a", "w", "id", "score"])


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("vector")
    flat = np.asarray(lists.flatten()).astype(np.float64)
    return np.asarray(batch.column("id")), np.asarray(batch.column("label")), flat.reshape(batch.num_rows, -1)


def _search(rows: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """``a, w, id, score, rank`` of the best rows of each window, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((block, low, high))

    def run(batches):
        search = Search(*shared.value, k, same)
        for batch in batches:
            for first in range(0, batch.num_rows, PIECE):
                search.add(*_columns(batch.slice(first, PIECE)))
        yield search.best()

    best = rows.mapInArrow(run, "a long, w long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """``id, label, vector`` of the rows that take part: components are floor(scale * x), as many in each row."""
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("_x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("_x").isNotNull()).where(finite)
    rows = materialized(rows.select("id", "label", F.transform("_x", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector")), "negatives-rows")
    size, shortest, count, ids = rows.agg(F.max(F.size("vector")), F.min(F.size("vector")), F.count("*"), F.countDistinct("id")).first()
    if size != shortest:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("vector"))))
    return rows.dropDuplicates() if count != ids else rows


def _blocks(anchors: DataFrame, block: int):
    """The anchors in blocks of at most ``block``, with their trees."""
    count = anchors.count()
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, -(-count // block)))))
    path = fresh_dir(anchors.sparkSession, "negatives-anchors")
    dealt.repartition("part").write.partitionBy("part").parquet(path)
    if not count:
        return
    dealt = anchors.sparkSession.read.schema(dealt.schema).parquet(path)
    for part in range(max(1, -(-count // block))):
        rows = dealt.where(F.col("part") == part).select("id", "label", "vector").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
        for first in range(0, rows.num_rows, block):
            ids, labels, vectors = _columns(rows.slice(first, block).combine_chunks().to_batches()[0])
            order, parent, length = spanning_tree(vectors)
            norm = float(np.sqrt((vectors * vectors).sum(1)).max())
            yield {"ids": ids, "labels": labels, "vectors": vectors, "order": order, "parent": parent, "length": length, "norm": norm}


def hard_negatives(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 1024) -> DataFrame:
    """For each anchor and positive, the first ``negatives`` rows of other labels whose score is from
    ``low`` to ``high`` hundredths of the positive's; ``vectors(vec_id, label, embedding)``, and
    ``anchor`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows, path = prepared(vectors, scale), fresh_dir(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(path)
    for own in _blocks(rows.where(anchor), block):
        n = len(own["ids"])
        nearest = _search(rows, own, np.full((n, 1), _LOW, np.int64), np.full((n, 1), _HIGH, np.int64), positives, True).toArrow()
        found, place = (nearest.column(x).to_numpy() for x in ("a", "rank"))
        ids, scores = (np.zeros((n, positives), np.int64) for _ in range(2))
        lows, highs = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
        ids[found, place - 1], scores[found, place - 1] = nearest.column("id").to_numpy(), nearest.column("score").to_numpy()
        # low * p <= 100 * s <= high * p in whole numbers.
        lows[found, place - 1] = [-(-low * int(p) // 100) for p in scores[found, place - 1]]
        highs[found, place - 1] = [high * int(p) // 100 for p in scores[found, place - 1]]
        best = _search(rows, own, lows, highs, negatives, False)
        a, w = np.divmod(np.arange(n * positives), positives)
        names = pa.table({"a": a, "w": w, "anchor_id": own["ids"][a], "positive_id": ids[a, w], "positive_score": scores[a, w]})
        named = best.join(F.broadcast(spark.createDataFrame(names)), ["a", "w"])  # block * positives rows
        named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)
