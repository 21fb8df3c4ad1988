"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.bytetext import text_bytes


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, *, rows: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bytes, starts, label`` of at most ``rows`` labelled texts of at most ``longest`` bytes.

    Rows are those with the smallest hashes of doc_id among usable ones, so the choice does not
    depend on how the tables are cut.  Null labels, ids and texts are left out.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(usable).select("doc_id", F.col(label).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)  # so many rows at most: broadcast
    picked = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    table = picked.select("doc_id", "_y", "text").toArrow().sort_by([("doc_id", "ascending"), ("_y", "ascending")])
    if not table.num_rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0)
    data, starts = text_bytes(pa.concat_arrays(table["text"].chunks))
    return data, starts, table["_y"].to_numpy()
