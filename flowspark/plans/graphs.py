"""Node dimension, cumulative node state, snapshots and neighbourhoods over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions.packets import is_internal, node_role
from flowspark.operators import graph
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS

ORDER = ["last_us", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
BATCH, RESET = 200, 1000


def _window():
    return F.floor(F.col("last_us") / v.WINDOW)


def _batched(spark, sf, size=BATCH, reset=0):
    return graph.batch_ordinals(v.flows_v(spark, sf), ["protocol"], ORDER, size, reset)


def node_roles(spark, sf):
    """Role of every (address, port) that sent or received, and whether the address is internal."""
    packets = v.packets_v(spark, sf)
    ends = [F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in ("src", "dst")]
    pairs = packets.select(F.explode(F.array(*ends)).alias("e")).select("e.*").distinct()
    role = node_role(F.col("ip"), F.col("port"))
    return pairs.select("ip", "port", role.alias("r"), is_internal(F.col("ip")).alias("internal")).select("ip", "port", "internal", "r.*")


def node_dimension(spark, sf):
    return graph.node_dim(v.flows_v(spark, sf), ORDER)


def node_dimension_by_protocol(spark, sf):
    return graph.node_dim(v.flows_v(spark, sf), ORDER, ["protocol"])


def edge_node_ids(spark, sf):
    flows = v.flows_v(spark, sf)
    rows = graph.with_node_ids(flows, graph.node_dim(flows, ORDER))
    return rows.select(*v.FLOW_IDENTITY, "src_id", "dst_id")


def edge_reverse_lookup(spark, sf):
    """Ids to addresses and back: packets per address pair through the id dimension."""
    flows = v.flows_v(spark, sf)
    dim = graph.node_dim(flows, ORDER)
    ids = graph.with_node_ids(flows, dim).groupBy("src_id", "dst_id").agg(F.sum("fwd_packets").alias("packets"))
    return graph.with_ips(ids, dim).select("src_ip", "dst_ip", "packets")


def node_statistics(spark, sf):
    return graph.node_stats(v.flows_v(spark, sf), _window())


def _vectors(spark, sf):
    flows = v.flows_v(spark, sf)
    return graph.node_vector16(graph.node_stats(flows, _window()), graph.node_dim(flows, ORDER))


def node_vectors(spark, sf):
    return _vectors(spark, sf).select(
        "window", "ip", "node_id", *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i:02d}") for i in range(16)]
    )


def window_states(spark, sf):
    rows = graph.window_state(_vectors(spark, sf), 16)
    return rows.select("window", "nodes", *[F.round(F.get("state", F.lit(i)), 6).alias(f"v{i:02d}") for i in range(16)])


def snapshot_edges(spark, sf):
    flows = v.flows_v(spark, sf)
    return graph.snapshot_edges(flows, graph.node_dim(flows, ORDER), _window(), "last_us")


def snapshot_export(spark, sf):
    """Dense edge lists of every window with the sixteen features and times, ends named by their numbers' addresses."""
    nodes, edges = graph.snapshot_export(v.flows_v(spark, sf), _window(), "last_us", FEATURE_COLUMNS)
    sizes = nodes.groupBy("window").agg(F.count(F.lit(1)).alias("nodes"), F.max("node").alias("last_node"))
    listed = edges.select("window", "src", "dst", "edge_us", *[F.round(F.get("attributes", F.lit(i)), 6).alias(c) for i, c in enumerate(FEATURE_COLUMNS)])
    return listed.join(sizes, "window")


def snapshot_nodes(spark, sf):
    flows = v.flows_v(spark, sf)
    return graph.snapshot_nodes(graph.node_stats(flows, _window()), graph.node_dim(flows, ORDER))


def snapshot_sizes(spark, sf):
    flows = v.flows_v(spark, sf)
    dim = graph.node_dim(flows, ORDER)
    return graph.snapshot_sizes(dim, graph.snapshot_edges(flows, dim, _window(), "last_us"), v.WINDOW)


def tumbling_windows(spark, sf):
    """Flows per window of their end time; the last window is still open and not emitted."""
    flows = v.flows_v(spark, sf).withColumn("window", _window())
    closed = flows.groupBy("window").agg(
        F.count(F.lit(1)).alias("flows"), F.countDistinct("src_ip").alias("sources"), F.max("last_us").alias("latest_us")
    )
    last = closed.agg(F.max("window").alias("_last"))
    return closed.join(F.broadcast(last), F.col("window") < F.col("_last")).drop("_last")  # one row


def batch_ordinals(spark, sf):
    return _batched(spark, sf, BATCH, RESET).select(*v.FLOW_IDENTITY, "row_no", "batch", "epoch")


def cold_start_first_batch(spark, sf):
    rows = graph.cold_start(_batched(spark, sf), "first_batch", ["protocol"])
    return rows.groupBy("protocol", "cold").agg(F.count(F.lit(1)).alias("flows"))


def cold_start_after_reset(spark, sf):
    rows = graph.cold_start(_batched(spark, sf, BATCH, RESET), "after_reset", ["protocol"], RESET, BATCH)
    return rows.groupBy("protocol", "epoch", "cold").agg(F.count(F.lit(1)).alias("flows"))


def cold_start_unseen(spark, sf):
    rows = graph.cold_start(_batched(spark, sf, 20), "unseen_endpoints", ["protocol"])
    return rows.select(*v.FLOW_IDENTITY, "batch", "cold")


def last_neighbors(spark, sf):
    flows = graph.batch_ordinals(v.flows_v(spark, sf), [], ORDER, BATCH)
    return graph.last_neighbors(flows, ORDER, 10)


def last_messages(spark, sf):
    rows = graph.last_message(v.flows_v(spark, sf), ORDER, "last_us")
    return rows.select("ip", "side", *v.FLOW_IDENTITY, "previous_us", "last_peer", F.round("log_dt", 6).alias("log_dt"))


def endpoints_after_first_day(spark, sf):
    """Endpoints of later flows that the first day did not know."""
    flows = v.flows_v(spark, sf).withColumn("day", F.floor(F.col("start_us") / (24 * v.HOUR)))
    first = flows.agg(F.min("day").alias("_first"))
    tagged = flows.crossJoin(F.broadcast(first))  # one row
    known = graph.endpoints(tagged.where("day = _first"), []).select("ip").distinct()
    return graph.new_endpoints(tagged.where("day > _first"), known)


def distinct_endpoints(spark, sf):
    ends = graph.endpoints(v.packets_v(spark, sf), ["protocol"])
    return ends.groupBy("protocol", "side").agg(
        F.countDistinct("ip").alias("hosts"), F.countDistinct("port").alias("ports"), F.countDistinct("ip", "port").alias("services")
    )


QUERIES = {
    f.__name__: f
    for f in (
        node_roles,
        node_dimension,
        node_dimension_by_protocol,
        edge_node_ids,
        edge_reverse_lookup,
        node_statistics,
        node_vectors,
        window_states,
        snapshot_edges,
        snapshot_export,
        snapshot_nodes,
        snapshot_sizes,
        tumbling_windows,
        batch_ordinals,
        cold_start_first_batch,
        cold_start_after_reset,
        cold_start_unseen,
        last_neighbors,
        last_messages,
        endpoints_after_first_day,
        distinct_endpoints,
    )
}

_F = v.FLOW_CTES
_ID = ", ".join(v.FLOW_IDENTITY)
_O = ", ".join(ORDER)
_ROLE = """CASE WHEN contains(lower(ip), 'calea') OR ip LIKE '%.250' OR port = 8443 THEN 'CALEA-Wiretap-Core'
  WHEN port IN (22, 23, 80, 443, 8080) AND (ip LIKE '10.0.%' OR ip LIKE '%.1') THEN 'Router-Admin-Core'
  WHEN port IN (445, 139, 3389, 3306, 5432) THEN 'Server-' || port WHEN port >= 1024 THEN 'Client' ELSE 'Service-' || port END"""
_ROLE_NO = """CASE WHEN role_name = 'CALEA-Wiretap-Core' THEN 3 WHEN role_name = 'Router-Admin-Core' THEN 2
  WHEN role_name = 'Client' THEN 0 ELSE 1 END"""
ENDS = f"""ends AS (SELECT {_O}, 0 AS side, src_ip AS ip, src_port AS port, dst_ip AS other_ip FROM flows_v
  UNION ALL SELECT {_O}, 1, dst_ip, dst_port, src_ip FROM flows_v)"""


def _dim(key: str = "") -> str:
    part = f"{key}, " if key else ""
    by = f"PARTITION BY {key}" if key else ""
    return f"""{ENDS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY {part}ip ORDER BY {_O}, side) AS k FROM ends),
dim AS (SELECT {part}ip, row_number() OVER ({by} ORDER BY {_O}, side) - 1 AS node_id, last_us AS first_seen_us,
  {_ROLE_NO} AS role, role_name FROM (SELECT *, {_ROLE} AS role_name FROM firsts WHERE k = 1) f)"""


_W = f"last_us // {v.WINDOW}"
_STATS = f"""deltas AS (SELECT ip, "window", CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, count(*) AS t,
    CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x FROM (
    SELECT src_ip AS ip, {_W} AS "window", 0 AS i, 1 AS o, CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' THEN 1 ELSE 0 END AS n,
      CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END AS x FROM flows_v
    UNION ALL SELECT dst_ip, {_W}, 1, 0, 0, 0 FROM flows_v) u GROUP BY 1, 2),
stats AS (SELECT ip, "window", CAST(sum(i) OVER w AS BIGINT) AS in_degree, CAST(sum(o) OVER w AS BIGINT) AS out_degree,
  CAST(sum(t) OVER w AS BIGINT) AS total_packets, CAST(sum(n) OVER w AS BIGINT) AS internal, CAST(sum(x) OVER w AS BIGINT) AS external
  FROM deltas WINDOW w AS (PARTITION BY ip ORDER BY "window"))"""
_VEC = """vecs AS (SELECT "window", ip, node_id, CAST(in_degree AS DOUBLE) AS v00, CAST(out_degree AS DOUBLE) AS v01,
  CAST(in_degree + out_degree AS DOUBLE) AS v02, in_degree / greatest(out_degree, 1) AS v03,
  internal / greatest(internal + external, 1) AS v04, CAST(total_packets AS DOUBLE) AS v05, CAST(role AS DOUBLE) AS v06,
  CAST(role = 0 AS DOUBLE) AS v07, CAST(role = 1 AS DOUBLE) AS v08, CAST(role = 2 AS DOUBLE) AS v09, CAST(role = 3 AS DOUBLE) AS v10,
  0.0::DOUBLE AS v11, 0.0::DOUBLE AS v12, 0.0::DOUBLE AS v13, 0.0::DOUBLE AS v14, 0.0::DOUBLE AS v15 FROM stats JOIN dim USING (ip))"""


def _batches(size: int, reset: int = 0, key: str = "protocol") -> str:
    by = f"PARTITION BY {key} " if key else ""
    per = -(-reset // size) if reset else 0
    epoch = f"((row_no - 1) // {size}) // {per}" if per else "CAST(0 AS BIGINT)"
    return f"""batched AS (SELECT *, (row_no - 1) // {size} AS batch, {epoch} AS epoch
  FROM (SELECT *, row_number() OVER ({by}ORDER BY {_O}) AS row_no FROM flows_v) r)"""


_D = 24 * v.HOUR
ORACLE = {
    "node_roles": f"""WITH {v.PACKETS}, p AS (SELECT src_ip AS ip, src_port AS port FROM packets_v UNION SELECT dst_ip, dst_port FROM packets_v), r AS (SELECT *, {_ROLE} AS role_name FROM p)
        SELECT ip, port, ip LIKE '10.%' OR ip LIKE '192.168.%' AS internal, {_ROLE_NO} AS role, role_name FROM r""",
    "node_dimension": f"{_F}, {_dim()} SELECT * FROM dim",
    "node_dimension_by_protocol": f"{_F}, {_dim('protocol')} SELECT * FROM dim",
    "edge_node_ids": f"""{_F}, {_dim()} SELECT {_ID}, a.node_id AS src_id, b.node_id AS dst_id FROM flows_v
        JOIN dim a ON a.ip = src_ip JOIN dim b ON b.ip = dst_ip""",
    "edge_reverse_lookup": f"{_F} SELECT src_ip, dst_ip, CAST(sum(fwd_packets) AS BIGINT) AS packets FROM flows_v GROUP BY 1, 2",
    "node_statistics": f'{_F}, {_STATS} SELECT * FROM stats',
    "node_vectors": f"""{_F}, {_dim()}, {_STATS}, {_VEC} SELECT "window", ip, node_id, {", ".join(f"round(v{i:02d}, 6) AS v{i:02d}" for i in range(16))} FROM vecs""",
    "window_states": f"""{_F}, {_dim()}, {_STATS}, {_VEC} SELECT "window", count(*) AS nodes,
        {", ".join(f"round(avg(v{i:02d}), 6) AS v{i:02d}" for i in range(16))} FROM vecs GROUP BY 1""",
    "snapshot_edges": f"""{_F}, {_dim()} SELECT {_W} AS "window", a.node_id AS src_id, b.node_id AS dst_id, last_us AS edge_us FROM flows_v
        JOIN dim a ON a.ip = src_ip JOIN dim b ON b.ip = dst_ip""",
    "snapshot_export": f"""{_F}, e AS (SELECT *, {_W} AS "window" FROM flows_v),
        k AS (SELECT "window", ip, row_number() OVER (PARTITION BY "window" ORDER BY ip) - 1 AS node FROM (SELECT "window", src_ip AS ip FROM e UNION SELECT "window", dst_ip FROM e) u),
        z AS (SELECT "window", count(*) AS nodes, max(node) AS last_node FROM k GROUP BY 1)
        SELECT e."window", a.node AS src, b.node AS dst, last_us AS edge_us, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FEATURE_COLUMNS)}, nodes, last_node
        FROM e JOIN k a ON a."window" = e."window" AND a.ip = src_ip JOIN k b ON b."window" = e."window" AND b.ip = dst_ip JOIN z ON e."window" = z."window" """,
    "snapshot_nodes": f"""{_F}, {_dim()}, {_STATS} SELECT node_id, ip, role, "window", lead("window") OVER (PARTITION BY ip ORDER BY "window") - 1 AS valid_to,
        in_degree, out_degree, total_packets, internal, external FROM stats JOIN dim USING (ip)""",
    "snapshot_sizes": f"""{_F}, {_dim()}, e AS (SELECT {_W} AS "window", count(*) AS edges FROM flows_v GROUP BY 1)
        SELECT "window", (SELECT count(*) FROM dim WHERE first_seen_us // {v.WINDOW} <= e."window") AS nodes, edges FROM e""",
    "tumbling_windows": f"""{_F}, w AS (SELECT {_W} AS "window", count(*) AS flows, count(DISTINCT src_ip) AS sources, max(last_us) AS latest_us FROM flows_v GROUP BY 1)
        SELECT * FROM w WHERE "window" < (SELECT max("window") FROM w)""",
    "batch_ordinals": f"{_F}, {_batches(BATCH, RESET)} SELECT {_ID}, row_no, batch, epoch FROM batched",
    "cold_start_first_batch": f"{_F}, {_batches(BATCH)} SELECT protocol, batch = 0 AS cold, count(*) AS flows FROM batched GROUP BY 1, 2",
    "cold_start_after_reset": f"""{_F}, {_batches(BATCH, RESET)}, s AS (SELECT *, min(batch) OVER (PARTITION BY protocol, epoch) AS b0 FROM batched)
        SELECT protocol, epoch, batch = b0 AS cold, count(*) AS flows FROM s GROUP BY 1, 2, 3""",
    "cold_start_unseen": f"""{_F}, {_batches(20)}, seen AS (SELECT protocol, ip, min(batch) AS b FROM (SELECT protocol, src_ip AS ip, batch FROM batched
          UNION ALL SELECT protocol, dst_ip, batch FROM batched) u GROUP BY 1, 2)
        SELECT {", ".join("x." + c for c in v.FLOW_IDENTITY)}, batch, a.b = batch AND d.b = batch AS cold FROM batched x
        JOIN seen a ON a.protocol = x.protocol AND a.ip = src_ip JOIN seen d ON d.protocol = x.protocol AND d.ip = dst_ip""",
    "last_neighbors": f"""{_F}, {_batches(BATCH, 0, "")}, be AS (SELECT {_O}, batch, 0 AS side, src_ip AS ip, dst_ip AS other_ip FROM batched
          UNION ALL SELECT {_O}, batch, 1, dst_ip, src_ip FROM batched),
        nb AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY {_O}, side) AS n FROM be),
        nodes_b AS (SELECT ip, batch, min(n) AS first FROM nb GROUP BY 1, 2)
        SELECT b.ip, b.batch, first - n AS back, other_ip, last_us AS at_us FROM nodes_b b JOIN nb e ON e.ip = b.ip AND e.n < b.first AND e.n >= b.first - 10""",
    "last_messages": f"""{_F}, {ENDS}, m AS (SELECT *, lag(last_us) OVER (PARTITION BY ip ORDER BY {_O}, side) AS previous_us,
          lag(other_ip) OVER (PARTITION BY ip ORDER BY {_O}, side) AS last_peer FROM ends)
        SELECT ip, side, {_ID}, previous_us, last_peer, round(ln(1 + (last_us - previous_us) / 1e6), 6) AS log_dt FROM m""",
    "endpoints_after_first_day": f"""{_F}, e AS (SELECT src_ip AS ip, start_us // {_D} AS d FROM flows_v UNION ALL SELECT dst_ip, start_us // {_D} FROM flows_v)
        SELECT ip FROM e GROUP BY 1 HAVING min(d) > (SELECT min(d) FROM e)""",
    "distinct_endpoints": f"""WITH {v.PACKETS}, e AS (SELECT protocol, 0 AS side, src_ip AS ip, src_port AS port FROM packets_v
          UNION ALL SELECT protocol, 1, dst_ip, dst_port FROM packets_v)
        SELECT protocol, side, count(DISTINCT ip) AS hosts, count(DISTINCT port) AS ports, count(DISTINCT (ip, port)) AS services FROM e GROUP BY 1, 2""",
}
