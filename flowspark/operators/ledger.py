"""Hash-chained ledgers of Merkle roots: verify, extend, relink and audit forks."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.hashing import sha256_text
from flowspark.operators.evidence import merkle_root
from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.session import checkpointed

# Fixed value: the parent of the first block.
GENESIS = "0" * 64
RELINK_ROWS = 100_000


def header_text(index: Column, leaf_count: Column, root: Column, previous: Column, timestamp: Column) -> Column:
    """Compact JSON of a block header, keys sorted; the timestamp as its stored number text."""
    return F.concat(
        F.lit('{"block_index":'), index.cast("string"),
        F.lit(',"leaf_count":'), leaf_count.cast("string"),
        F.lit(',"merkle_root":"'), root,
        F.lit('","prev_block_hash":"'), previous,
        F.lit('","timestamp":'), timestamp, F.lit("}"),
    )


def block_hash(blocks: DataFrame) -> Column:
    c = {n: F.col(n) for n in ("block_index", "leaf_count", "merkle_root", "prev_block_hash", "timestamp")}
    return sha256_text(header_text(c["block_index"], c["leaf_count"], c["merkle_root"], c["prev_block_hash"], c["timestamp"]))


def recomputed_roots(blocks: DataFrame) -> DataFrame:
    leaves = blocks.select("block_index", F.posexplode("leaf_hashes").alias("pos", "leaf"))
    leaves = leaves.withColumn("pos", F.col("pos").cast("bigint"))
    return merkle_root(leaves, ["block_index"]).select("block_index", F.col("root").alias("_root"), F.col("leaves").alias("_leaves"))


def verify_ledger(blocks: DataFrame, roots: DataFrame | None = None, limit: int = ROWS_PER_TASK, order: tuple[str, ...] = ("block_index",)) -> DataFrame:
    """Every block with ``reason``, the first failed check, NULL when it verifies.

    Comparisons are null-safe: a missing hash, parent, root or index fails its check.

    ``roots`` (block_index, _root, _leaves) may be given when the leaves live in a table
    of their own instead of ``leaf_hashes``.  ``order`` is the order the blocks stand in: with
    ``("file", "line")`` of a scanned ledger, blocks that were swapped fail their sequence.
    """
    if roots is None:
        roots = recomputed_roots(blocks)
    rows = ordered(blocks, [], list(order), limit)
    rows = rows.lag(_prev_hash="block_hash").running(_no=("sum", F.lit(1).cast("bigint"))).done()
    joined = rows.join(roots, "block_index", "left")
    genesis = F.coalesce("_prev_hash", F.lit(GENESIS))
    reason = (
        F.when(~F.col("block_index").eqNullSafe(F.col("_no") - 1), "index_sequence")
        .when(F.col("_leaves").isNull() | ~F.col("leaf_count").eqNullSafe(F.col("_leaves")), "leaf_count")
        .when(~F.col("block_hash").eqNullSafe(block_hash(blocks)), "block_hash")
        .when(~F.col("prev_block_hash").eqNullSafe(genesis), "previous_hash")
        .when(~F.col("merkle_root").eqNullSafe(F.col("_root")), "merkle_root")
    )
    return joined.select(*blocks.columns, reason.alias("reason"))


def ledger_tips(blocks: DataFrame) -> DataFrame:
    """Blocks that no other block names as parent."""
    parents = blocks.select(F.col("prev_block_hash").alias("block_hash")).distinct()
    return blocks.join(parents, "block_hash", "left_anti")


def ledger_branches(blocks: DataFrame) -> DataFrame:
    """Per tip: length of its branch to genesis, whether it ends there and whether its
    indices run 0..n-1.  Pointer doubling: log2 of the longest branch joins, not its length.
    """
    index = blocks.select("block_hash", "prev_block_hash", "block_index")
    parent = index.select(F.col("block_hash").alias("prev_block_hash"), F.col("block_index").alias("_parent_index"))
    start = index.join(parent, "prev_block_hash", "left")
    first = F.col("prev_block_hash") == GENESIS
    follows = F.when(first, F.col("block_index") == 0).otherwise(
        F.coalesce(F.col("block_index") == F.col("_parent_index") + 1, F.lit(False))
    )
    # `jump` is the ancestor reached, `hops` the blocks passed, `ok` that all of them follow on.
    state = start.select(
        "block_hash", F.when(first | F.col("_parent_index").isNull(), F.lit(None)).otherwise(F.col("prev_block_hash")).alias("jump"),
        F.lit(1).cast("bigint").alias("hops"), follows.alias("ok"),
        (~first & F.col("_parent_index").isNull()).alias("missing"),
    )
    state = checkpointed(state)
    total = state.count()
    for _ in range(max(1, math.ceil(math.log2(total + 1)))):
        if state.where("jump IS NOT NULL").isEmpty():
            break
        ahead = state.select(
            F.col("block_hash").alias("jump"), F.col("jump").alias("_jump"), F.col("hops").alias("_hops"),
            F.col("ok").alias("_ok"), F.col("missing").alias("_missing"),
        )
        state = checkpointed(
            state.join(ahead, "jump", "left").select(
                "block_hash", F.col("_jump").alias("jump"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), (F.col("missing") | F.coalesce("_missing", F.lit(False))).alias("missing"),
            )
        )
    tips = ledger_tips(blocks).select("block_hash")
    outcome = (
        F.when(F.col("jump").isNotNull(), "cycle").when(F.col("missing"), "missing_parent").when(F.col("ok"), "valid").otherwise("index_order")
    )
    return tips.join(state, "block_hash").select(F.col("block_hash").alias("tip"), F.col("hops").alias("blocks"), outcome.alias("outcome"))


def _chain(previous: str):
    """Hash one chunk of headers in order, continuing from the chunk before."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block_index", kind="stable")
        links, current = [], previous
        for head, tail in zip(frame["_head"], frame["_tail"]):
            links.append(current)
            current = hashlib.sha256((head + current + tail).encode()).hexdigest()
        return frame.assign(prev_block_hash=links, block_hash=links[1:] + [current]).drop(columns=["_head", "_tail"])

    return fold


def relink(headers: DataFrame, rows: int = RELINK_ROWS, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Re-chain headers (position, leaf_count, merkle_root, timestamp) from genesis.

    A hash chain is sequential, so chunks of ``rows`` headers are folded one after another;
    a task holds one chunk and only the last hash passes from one to the next.
    """
    numbered = ordered(headers, [], ["position"], limit).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    cut = F.lit("\u0001")
    text = header_text(F.col("block_index"), F.col("leaf_count"), F.col("merkle_root"), cut, F.col("timestamp"))
    ready = numbered.withColumn("block_index", F.col("_n") - 1).withColumn("_text", F.split(text, "\u0001"))
    ready = ready.select(
        "position", "block_index", F.floor((F.col("_n") - 1) / rows).alias("_chunk"),
        F.get("_text", F.lit(0)).alias("_head"), F.get("_text", F.lit(1)).alias("_tail"),
    )
    ready = checkpointed(ready)
    chunks = (ready.agg(F.max("_chunk")).first()[0] or 0) + 1
    schema = "position bigint, block_index bigint, _chunk bigint, prev_block_hash string, block_hash string"
    previous, out = GENESIS, None
    for chunk in range(chunks):
        part = ready.where(F.col("_chunk") == chunk).groupBy("_chunk").applyInPandas(_chain(previous), schema)
        part = checkpointed(part)
        out = part if out is None else out.unionByName(part)
        if chunk < chunks - 1:
            previous = part.agg(F.max_by("block_hash", "block_index")).first()[0]
    return out.drop("_chunk")


def new_block(leaves: DataFrame, last: tuple[int, str] | None, timestamp: str) -> DataFrame:
    """One block over a batch of leaf hashes (pos, leaf); an empty batch is an error.

    The leaves stay a table of their own keyed by block index, whatever their number.
    """
    index, previous = (last[0] + 1, last[1]) if last else (0, GENESIS)
    if leaves.isEmpty():
        raise ValueError("cannot commit an empty batch")
    root = merkle_root(leaves, [])
    block = root.select(
        F.lit(index).cast("bigint").alias("block_index"), F.lit(timestamp).alias("timestamp"), F.lit(previous).alias("prev_block_hash"),
        F.col("root").alias("merkle_root"), F.col("leaves").alias("leaf_count"),
    )
    return block.withColumn("block_hash", block_hash(block))
