"""Temporal graph tables: node dimension, roles, cumulative state, neighbourhoods.

Edges are flow rows.  An order column list must identify a row; sources come before
destinations inside a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import signed_log1p
from flowspark.functions.packets import is_internal, node_role
from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.session import checkpointed


def endpoints(flows: DataFrame, keep: list[str]) -> DataFrame:
    """Both ends of every row: ``ip``, ``port``, ``side`` (0 source, 1 destination)."""

    def end(side: int, name: str, other: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.col(f"{name}_ip").alias("ip"),
            F.col(f"{name}_port").alias("port"),
            F.col(f"{other}_ip").alias("other_ip"),
        )

    both = F.explode(F.array(end(0, "src", "dst"), end(1, "dst", "src")))
    return flows.select(*keep, both.alias("_e")).select(*keep, "_e.*")


def node_dim(
    flows: DataFrame, order: list[str], keys: list[str] | None = None, max_nodes: int | None = None, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Dense node ids in first-seen order per key, with the role frozen at first sight.

    Fails when run if a key needs more than ``max_nodes`` ids.
    """
    keys = keys or []
    ends = endpoints(flows, [*keys, *order])
    position = F.struct(*order, "side")
    first = ends.groupBy(*keys, "ip").agg(
        F.min(position).alias("_first"), F.min_by("port", position).alias("first_port")
    )
    flat = first.select(*keys, "ip", "first_port", *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate([*order, "side"])])
    rows = ordered(flat, keys, [f"_o{i}" for i in range(len(order) + 1)], limit)
    rows = rows.running(_n=("sum", F.lit(1).cast("bigint")))
    node = F.col("_n") - 1
    if max_nodes is not None:
        node = F.when(node >= max_nodes, F.raise_error(F.lit("node capacity exceeded")).cast("bigint")).otherwise(node)
    role = node_role(F.col("ip"), F.col("first_port"))
    return rows.done().select(
        *keys, "ip", node.alias("node_id"), F.col("_o0").alias("first_seen_us"), role.alias("_r")
    ).select(*keys, "ip", "node_id", "first_seen_us", F.col("_r.role").alias("role"), F.col("_r.role_name").alias("role_name"))


def with_node_ids(flows: DataFrame, dim: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    src = dim.select(*keys, F.col("ip").alias("src_ip"), F.col("node_id").alias("src_id"))
    dst = dim.select(*keys, F.col("ip").alias("dst_ip"), F.col("node_id").alias("dst_id"))
    return flows.join(src, [*keys, "src_ip"]).join(dst, [*keys, "dst_ip"])


def with_ips(edges: DataFrame, dim: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The reverse lookup of ``src_id`` and ``dst_id``."""
    keys = keys or []
    src = dim.select(*keys, F.col("node_id").alias("src_id"), F.col("ip").alias("src_ip"))
    dst = dim.select(*keys, F.col("node_id").alias("dst_id"), F.col("ip").alias("dst_ip"))
    return edges.join(src, [*keys, "src_id"]).join(dst, [*keys, "dst_id"])


NODE_COUNTERS = ["in_degree", "out_degree", "total_packets", "internal", "external"]


def node_stats(flows: DataFrame, window: Column, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Node counters per window in which the node was active, cumulative and never reset.

    Rows collapse to (node, window) before anything is ordered.
    """
    ends = endpoints(flows.withColumn("window", window).withColumn("_in", is_internal(F.col("dst_ip"))), ["window", "_in"])
    source = F.col("side") == 0
    delta = ends.groupBy("ip", "window").agg(
        F.count_if(~source).alias("in_degree"),
        F.count_if(source).alias("out_degree"),
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if(source & F.col("_in")).alias("internal"),
        F.count_if(source & ~F.col("_in")).alias("external"),
    )
    renamed = delta.select("ip", "window", *[F.col(c).alias(f"_{c}") for c in NODE_COUNTERS])
    rows = ordered(renamed, ["ip"], ["window"], limit)
    total = rows.running(**{c: ("sum", f"_{c}") for c in NODE_COUNTERS}).done()
    return total.select("ip", "window", *NODE_COUNTERS)


def node_vector16(stats: DataFrame, dim: DataFrame) -> DataFrame:
    """Node state vectors: degrees, ratios, volume and role, padded to sixteen."""
    rows = stats.join(dim.select("ip", "node_id", "role"), "ip")
    inn, out = F.col("in_degree"), F.col("out_degree")
    contacts = F.greatest(F.col("internal") + F.col("external"), F.lit(1))
    parts = [
        inn,
        out,
        inn + out,
        inn / F.greatest(out, F.lit(1)),
        F.col("internal") / contacts,
        F.col("total_packets"),
        F.col("role"),
        *[(F.col("role") == r).cast("int") for r in range(4)],
        *[F.lit(0.0)] * 5,
    ]
    vector = F.array(*[p.cast("double") for p in parts])
    return rows.select("window", "ip", "node_id", vector.alias("vector"))


def window_state(vectors: DataFrame, dims: int, keys: list[str] | None = None) -> DataFrame:
    """Mean vector over the nodes active in a window."""
    means = [F.avg(F.get("vector", F.lit(i))) for i in range(dims)]
    return vectors.groupBy(*(keys or []), "window").agg(F.count(F.lit(1)).alias("nodes"), F.array(*means).alias("state"))


def snapshot_edges(flows: DataFrame, dim: DataFrame, window: Column, ts: str) -> DataFrame:
    """One row per interaction in its window with dense node ids.

    First-seen ids are already dense over all nodes known at the close of a window, so
    they are the export index.
    """
    rows = with_node_ids(flows.withColumn("window", window), dim)
    return rows.select("window", "src_id", "dst_id", F.col(ts).alias("edge_us"))


def snapshot_export(flows: DataFrame, window: Column, ts: str, attributes: list[str], limit: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each window for a dense tensor: ``window, node, ip`` with nodes numbered from 0 in
    the order of their addresses, and ``window, src, dst, edge_us, attributes``.

    A window's numbers are running counts over its distinct addresses, cut by position where a window
    is large; edges find their ends by (window, address).
    """
    rows = flows.withColumn("window", window)
    ends = rows.select("window", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    nodes = ordered(ends, ["window"], ["ip"], limit).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    nodes = checkpointed(nodes.select("window", (F.col("_n") - 1).alias("node"), "ip"))
    number = lambda end, name: nodes.select("window", F.col("node").alias(name), F.col("ip").alias(end))
    joined = rows.join(number("src_ip", "src"), ["window", "src_ip"]).join(number("dst_ip", "dst"), ["window", "dst_ip"])
    values = F.array(*[F.col(c).cast("double") for c in attributes])
    return nodes, joined.select("window", "src", "dst", F.col(ts).alias("edge_us"), values.alias("attributes"))


def snapshot_nodes(stats: DataFrame, dim: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Node versions: the frozen counters hold from ``window`` through ``valid_to``.

    A snapshot of window w is the set of versions covering w; storing versions avoids
    repeating every known node in every window.  ``valid_to`` is NULL for the latest.
    """
    back = stats.withColumn("_rev", -F.col("window"))
    rows = ordered(back, ["ip"], ["_rev"], limit).lag(_next="window").done()
    keyed = rows.join(dim.select("ip", "node_id", "role"), "ip")
    return keyed.select("node_id", "ip", "role", "window", (F.col("_next") - 1).alias("valid_to"), *NODE_COUNTERS)


def snapshot_sizes(dim: DataFrame, edges: DataFrame, width_us: int, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per window with edges: nodes known at its close and edges inside it."""
    known = dim.groupBy(F.floor(F.col("first_seen_us") / width_us).alias("window")).agg(
        F.count(F.lit(1)).alias("_new"), F.lit(0).cast("bigint").alias("_edges")
    )
    inside = edges.groupBy("window").agg(F.lit(0).cast("bigint").alias("_new"), F.count(F.lit(1)).alias("_edges"))
    both = known.unionByName(inside).groupBy("window").agg(F.sum("_new").alias("_new"), F.sum("_edges").alias("edges"))
    rows = ordered(both, [], ["window"], limit).running(nodes=("sum", "_new")).done()
    return rows.where("edges > 0").select("window", "nodes", "edges")


def batch_ordinals(
    rows: DataFrame, keys: list[str], order: list[str], size: int, reset: int = 0, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``row_no``, fixed-size ``batch`` and history ``epoch`` per capture.

    History restarts at the first batch boundary after ``reset`` rows; 0 never restarts.
    """
    if size < 1 or reset < 0:
        raise ValueError("positive batch size required")
    numbered = ordered(rows, keys, order, limit).running(row_no=("sum", F.lit(1).cast("bigint"))).done()
    batch = F.floor((F.col("row_no") - 1) / size)
    per_epoch = math.ceil(reset / size) if reset else None
    epoch = F.floor(F.col("batch") / per_epoch) if per_epoch else F.lit(0).cast("bigint")
    return numbered.withColumn("batch", batch).withColumn("epoch", epoch)


def cold_start(batched: DataFrame, rule: str, keys: list[str], reset: int = 0, size: int = 1) -> DataFrame:
    """Add ``cold``: ``first_batch`` of a sequence, ``after_reset`` batch of an epoch, or
    ``unseen_endpoints`` when neither end occurred in an earlier batch."""
    if rule == "first_batch":
        return batched.withColumn("cold", F.col("batch") == 0)
    if rule == "after_reset":
        per_epoch = math.ceil(reset / size) if reset else None
        first = F.col("batch") % per_epoch == 0 if per_epoch else F.col("batch") == 0
        return batched.withColumn("cold", first)
    if rule != "unseen_endpoints":
        raise ValueError(f"unknown cold-start rule {rule!r}")
    seen = endpoints(batched, [*keys, "batch"]).groupBy(*keys, "ip").agg(F.min("batch").alias("_first"))
    src = seen.select(*keys, F.col("ip").alias("src_ip"), F.col("_first").alias("_src_first"))
    dst = seen.select(*keys, F.col("ip").alias("dst_ip"), F.col("_first").alias("_dst_first"))
    joined = batched.join(src, [*keys, "src_ip"]).join(dst, [*keys, "dst_ip"])
    cold = (F.col("_src_first") == F.col("batch")) & (F.col("_dst_first") == F.col("batch"))
    return joined.withColumn("cold", cold).drop("_src_first", "_dst_first")


def last_neighbors(batched: DataFrame, order: list[str], k: int = 10, limit: int = ROWS_PER_TASK) -> DataFrame:
    """The last ``k`` interactions of every node before each batch it takes part in.

    Interactions are numbered per node; a node's neighbourhood at a batch is the numbers
    just before its first one there, fetched by equality on (node, number).
    """
    ends = endpoints(batched, ["batch", *order])
    rows = ordered(ends, ["ip"], [*order, "side"], limit).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    first = rows.groupBy("ip", "batch").agg(F.min("_n").alias("_first"))
    wanted = first.where("_first > 1").select(
        "ip", "batch", "_first", F.explode(F.sequence(F.greatest(F.col("_first") - k, F.lit(1)), F.col("_first") - 1)).alias("_n")
    )
    found = wanted.join(rows.select("ip", "_n", "other_ip", F.col(order[0]).alias("at_us")), ["ip", "_n"])
    return found.select("ip", "batch", (F.col("_first") - F.col("_n")).alias("back"), "other_ip", "at_us")


def last_message(flows: DataFrame, order: list[str], ts: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Every endpoint's previous interaction time and the signed-log seconds since."""
    ends = endpoints(flows.withColumn("_ts", F.col(ts)), ["_ts", *order])
    rows = ordered(ends, ["ip"], [*order, "side"], limit).lag(_prev="_ts", _prev_other="other_ip").done()
    since = (F.col("_ts") - F.col("_prev")) / 1e6
    return rows.select(
        "ip", "side", *order, F.col("_prev").alias("previous_us"), F.col("_prev_other").alias("last_peer"), signed_log1p(since).alias("log_dt")
    )


def new_endpoints(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct endpoints of a batch that were not known before."""
    src, dst = batch.select(F.col("src_ip").alias("ip")), batch.select(F.col("dst_ip").alias("ip"))
    return src.unionByName(dst).distinct().join(known.select("ip"), "ip", "left_anti")
