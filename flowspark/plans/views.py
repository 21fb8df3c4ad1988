"""Typed inputs derived from the supplied tables by fixed expressions.

The tables hold no packets or model scores, so every query derives them: packets and
flows from ``events``, scored rows from ``lineitem``, window states and stage
probabilities from ``embeddings``, ledger leaves and payloads from ``documents``.
Each view has a Spark form and a SQL form that must agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.flows import assemble_flows, flow_features, largest_conversation
from flowspark.operators.ordered import ordered
from flowspark.schemas import FEATURE_COLUMNS
from flowspark.session import materialized

HOUR = 3_600_000_000
IDLE, ACTIVE = 24 * HOUR, 72 * HOUR
SCAN_WINDOW, SCAN_PORTS = 24 * HOUR, 12
WINDOW = 6 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_of(events: DataFrame) -> DataFrame:
    """The packet view of an ``events`` frame, batch or streaming."""
    events = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    k, user = F.col("k"), F.col("user_id")
    host_ip = F.concat_ws(".", F.lit("10.0"), F.floor(user / 50).cast("string"), (user % 50 + 1).cast("string"))
    base = events.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        host_ip.alias("host_ip"),
        (F.lit(40000) + user).cast("int").alias("host_port"),
        F.concat(F.lit("192.168.1."), (F.lit(10) + k % 5).cast("string")).alias("svc_ip"),
        F.when(k >= 97, 123)
        .when(k % 5 == 0, 22)
        .when(k % 5 == 1, 80)
        .when(k % 5 == 2, 443)
        .when(k % 5 == 3, 445)
        .otherwise(53)
        .alias("svc_port"),
        F.when((k >= 97) | (k % 5 == 4), "udp").otherwise("tcp").alias("protocol"),
        (F.lit(40) + F.floor("value").cast("int")).alias("length"),
        "event_type",
        "props",
    )
    out, seq = F.col("seq") % 3 != 0, F.col("seq")
    flags = (
        F.when(F.col("protocol") == "udp", F.lit(None).cast("int"))
        .when(F.col("event_type") == "signup", 2)
        .when(F.col("event_type") == "purchase", 18)
        .when(F.col("event_type") == "click", 16)
        .when(F.col("event_type") == "view", 24)
        .when(seq % 2 == 0, 1)
        .otherwise(4)
    )
    return base.select(
        "seq",
        "ts_us",
        F.when(out, F.col("host_ip")).otherwise(F.col("svc_ip")).alias("src_ip"),
        F.when(out, F.col("svc_ip")).otherwise(F.col("host_ip")).alias("dst_ip"),
        F.when(out, F.col("host_port")).otherwise(F.col("svc_port")).alias("src_port"),
        F.when(out, F.col("svc_port")).otherwise(F.col("host_port")).alias("dst_port"),
        "protocol",
        "length",
        flags.alias("tcp_flags"),
        (F.lit(1024) * (seq % 8)).cast("int").alias("tcp_window"),
        (F.lit(32) + seq % 64).cast("int").alias("ttl"),
        F.col("props").cast("binary").alias("payload"),
    )


PACKETS = """
packets_v AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us,
    CASE WHEN event_id % 3 <> 0 THEN host_ip ELSE svc_ip END AS src_ip,
    CASE WHEN event_id % 3 <> 0 THEN svc_ip ELSE host_ip END AS dst_ip,
    CASE WHEN event_id % 3 <> 0 THEN host_port ELSE svc_port END AS src_port,
    CASE WHEN event_id % 3 <> 0 THEN svc_port ELSE host_port END AS dst_port,
    CASE WHEN k >= 97 OR k % 5 = 4 THEN 'udp' ELSE 'tcp' END AS protocol,
    40 + CAST(floor(value) AS INT) AS length,
    CASE WHEN k >= 97 OR k % 5 = 4 THEN NULL WHEN event_type = 'signup' THEN 2
      WHEN event_type = 'purchase' THEN 18 WHEN event_type = 'click' THEN 16
      WHEN event_type = 'view' THEN 24 WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS tcp_flags,
    CAST(1024 * (event_id % 8) AS INT) AS tcp_window,
    CAST(32 + event_id % 64 AS INT) AS ttl, props AS payload
  FROM (SELECT *,
      concat('10.0.', CAST(CAST(floor(user_id / 50) AS INT) AS VARCHAR), '.', CAST(user_id % 50 + 1 AS VARCHAR)) AS host_ip,
      concat('192.168.1.', CAST(10 + k % 5 AS VARCHAR)) AS svc_ip, CAST(40000 + user_id AS INT) AS host_port,
      CASE WHEN k >= 97 THEN 123 WHEN k % 5 = 0 THEN 22 WHEN k % 5 = 1 THEN 80
        WHEN k % 5 = 2 THEN 443 WHEN k % 5 = 3 THEN 445 ELSE 53 END AS svc_port
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) a) b)"""


def packets_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(table(spark, sf_dir, "events"))


def assembled_v(spark: SparkSession, sf_dir: str, keep: bool = False) -> tuple[DataFrame, int]:
    """Packets cut into flows, and the size of the busiest conversation.

    ``keep`` writes them once, for queries that go over them more than once.
    """
    packets = packets_v(spark, sf_dir)
    largest = largest_conversation(packets)
    cut = assemble_flows(packets, IDLE, ACTIVE, largest=largest)
    return (materialized(cut, "assembled") if keep else cut), largest


def flows_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table, written once: rules and graph operators read it several times."""
    return materialized(flow_features(assembled_v(spark, sf_dir)[0]), "flows")


# Greedy assembly by walking every conversation packet by packet.
FLOW_PACKETS = f"""
keyed AS (
  SELECT *, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS lo,
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS hi,
    src_ip || ':' || src_port AS src,
    row_number() OVER (PARTITION BY least(src_ip || ':' || src_port, dst_ip || ':' || dst_port),
      greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port), protocol ORDER BY ts_us, seq) AS rn,
    protocol = 'tcp' AND (coalesce(tcp_flags, 0) & 4) <> 0 AS is_rst,
    protocol = 'tcp' AND (coalesce(tcp_flags, 0) & 1) <> 0 AS is_fin
  FROM packets_v),
walk AS (
  SELECT lo, hi, protocol, rn, seq, 1 AS flow_no, ts_us AS start_us, ts_us AS last_us, src AS init,
    is_fin AS fin_f, false AS fin_b, is_rst AS closed
  FROM keyed WHERE rn = 1
  UNION ALL
  SELECT k.lo, k.hi, k.protocol, k.rn, k.seq,
    CASE WHEN c.cut THEN w.flow_no + 1 ELSE w.flow_no END,
    CASE WHEN c.cut THEN k.ts_us ELSE w.start_us END, k.ts_us,
    CASE WHEN c.cut THEN k.src ELSE w.init END,
    CASE WHEN c.cut THEN k.is_fin ELSE w.fin_f OR (k.is_fin AND k.src = w.init) END,
    CASE WHEN c.cut THEN false ELSE w.fin_b OR (k.is_fin AND k.src <> w.init) END,
    CASE WHEN c.cut THEN k.is_rst ELSE k.is_rst
      OR ((w.fin_f OR (k.is_fin AND k.src = w.init)) AND (w.fin_b OR (k.is_fin AND k.src <> w.init))) END
  FROM walk w JOIN keyed k ON k.lo = w.lo AND k.hi = w.hi AND k.protocol = w.protocol AND k.rn = w.rn + 1
    CROSS JOIN LATERAL (SELECT w.closed OR k.ts_us - w.last_us >= {IDLE} OR k.ts_us - w.start_us >= {ACTIVE} AS cut) c),
flow_packets AS (
  SELECT p.*, w.flow_no, w.init, p.src = w.init AS forward
  FROM keyed p JOIN walk w ON p.lo = w.lo AND p.hi = w.hi AND p.protocol = w.protocol AND p.rn = w.rn)"""

FLOWS = """
flows_v AS (
  SELECT lo, hi, protocol, flow_no, src_ip, dst_ip, src_port, dst_port, start_us, last_us, duration_us,
    fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, syn_count, syn_ack_count, ack_count, rst_count, fin_count,
    syn_count / (ack_count + 1) AS syn_ack_ratio,
    CASE WHEN fwd_packets > 0 THEN fwd_bytes / fwd_packets ELSE 0 END AS fwd_len_mean,
    CASE WHEN bwd_packets > 0 THEN bwd_bytes / bwd_packets ELSE 0 END AS bwd_len_mean,
    CASE WHEN duration_us > 0 THEN (fwd_bytes + bwd_bytes) / (duration_us / 1e6) ELSE 0 END AS bytes_per_s,
    CASE WHEN duration_us > 0 THEN (fwd_packets + bwd_packets) / (duration_us / 1e6) ELSE 0 END AS packets_per_s,
    CASE WHEN fwd_packets + bwd_packets > 1 THEN duration_us / (fwd_packets + bwd_packets - 1) ELSE 0 END AS iat_mean_us,
    CASE WHEN fwd_packets > 1 THEN fwd_span / (fwd_packets - 1) ELSE 0 END AS fwd_iat_mean_us,
    CASE WHEN bwd_packets > 1 THEN bwd_span / (bwd_packets - 1) ELSE 0 END AS bwd_iat_mean_us,
    CASE WHEN duration_us > 0 THEN fwd_packets / (duration_us / 1e6) ELSE 0 END AS fwd_packets_per_s,
    CASE WHEN duration_us > 0 THEN bwd_packets / (duration_us / 1e6) ELSE 0 END AS bwd_packets_per_s,
    (fwd_bytes + bwd_bytes) / greatest(fwd_packets + bwd_packets, 1) AS avg_packet_size,
    bwd_packets / greatest(fwd_packets, 1) AS down_up_ratio
  FROM (
    SELECT lo, hi, protocol, flow_no, arg_min(src_ip, seq) AS src_ip, arg_min(dst_ip, seq) AS dst_ip,
      arg_min(src_port, seq) AS src_port, arg_min(dst_port, seq) AS dst_port,
      min(ts_us) AS start_us, max(ts_us) AS last_us, max(ts_us) - min(ts_us) AS duration_us,
      count(*) FILTER (forward) AS fwd_packets, count(*) FILTER (NOT forward) AS bwd_packets,
      CAST(coalesce(sum(length) FILTER (forward), 0) AS BIGINT) AS fwd_bytes,
      CAST(coalesce(sum(length) FILTER (NOT forward), 0) AS BIGINT) AS bwd_bytes,
      max(ts_us) FILTER (forward) - min(ts_us) FILTER (forward) AS fwd_span,
      max(ts_us) FILTER (NOT forward) - min(ts_us) FILTER (NOT forward) AS bwd_span,
      count(*) FILTER (forward AND protocol = 'tcp' AND (tcp_flags & 18) = 2) AS syn_count,
      count(*) FILTER (NOT forward AND protocol = 'tcp' AND (tcp_flags & 18) = 18) AS syn_ack_count,
      count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 18) = 16) AS ack_count,
      count(*) FILTER (is_rst) AS rst_count, count(*) FILTER (is_fin) AS fin_count
    FROM flow_packets GROUP BY lo, hi, protocol, flow_no) s)"""

FLOW_CTES = f"WITH RECURSIVE {PACKETS}, {FLOW_PACKETS}, {FLOWS}"
FLOW_IDENTITY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us"]


def model_scored(flows: DataFrame) -> DataFrame:
    """Flows with a stand-in model score and stage, as the tables hold none."""
    octets = (F.col("fwd_bytes") + F.col("bwd_bytes")) % 101
    return flows.withColumns(
        {
            "model_p": octets / F.lit(100.0),
            "model_stage": ((F.col("fwd_packets") + F.col("bwd_packets") + F.col("dst_port")) % 8).cast("int"),
        }
    )


MODEL_SCORED = """
scored_flows AS (
  SELECT *, CAST((fwd_bytes + bwd_bytes) % 101 AS DOUBLE) / 100.0 AS model_p,
    CAST((fwd_packets + bwd_packets + dst_port) % 8 AS INT) AS model_stage FROM flows_v)"""


def scored_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        year.alias("capture"),
        F.when(year <= 1997, "train")
        .when(year == 1998, "validation")
        .when(year == 1999, "calibration")
        .otherwise("test")
        .alias("split"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.round(F.col("l_discount") * 100).cast("int") / F.lit(10.0)).alias("p"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") % 8).cast("int")).alias("stage"),
        (F.col("l_quantity").cast("int") % 8).alias("stage_pred"),
    )


SCORED = """
scored_v AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(year(l_shipdate) AS INT) AS capture,
    CASE WHEN year(l_shipdate) <= 1997 THEN 'train' WHEN year(l_shipdate) = 1998 THEN 'validation'
      WHEN year(l_shipdate) = 1999 THEN 'calibration' ELSE 'test' END AS split,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CAST(round(l_discount * 100) AS INT) / 10.0::DOUBLE AS p,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber % 8 AS INT) END AS stage,
    CAST(CAST(l_quantity AS INT) % 8 AS INT) AS stage_pred
  FROM lineitem)"""


#: Numbers of a supplied embedding.
STATE_DIMS = 64


def states_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window states: every sixth window is followed by a gap."""
    rows = ordered(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"])
    rows = rows.running(rank=("sum", F.lit(1))).done().withColumn("rank", F.col("rank") - 1)
    return rows.select(
        F.col("label").alias("capture"),
        (F.col("rank") + F.floor(F.col("rank") / 6)).cast("bigint").alias("window"),
        F.transform("embedding", lambda x: x.cast("double")).alias("state"),
    )


STATES = """
states_v AS (
  SELECT label AS capture, CAST(r + floor(r / 6) AS BIGINT) AS "window",
    [CAST(x AS DOUBLE) FOR x IN embedding] AS state
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings) e)"""


def stage_probs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight class masses: the sizes of every eighth number of the embedding, over their sum."""
    eighths = F.sequence(F.lit(0), F.lit(STATE_DIMS // 8 - 1))
    first = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.aggregate(eighths, F.lit(0.0), lambda a, k: a + F.abs(F.get("embedding", c + 8 * k).cast("double"))))
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), first.alias("a"), total.alias("t"))
    return rows.select(
        "vec_id", (F.col("label") % 8).alias("y"), F.transform("a", lambda x: x / F.col("t")).alias("probs")
    )


STAGE_PROBS = """
stage_probs_v AS (
  SELECT vec_id, label % 8 AS y, [x / t FOR x IN a] AS probs
  FROM (SELECT vec_id, label, a, list_reduce(a, lambda s, x: s + x) AS t
    FROM (SELECT vec_id, label, [list_reduce([abs(CAST(embedding[c + 8 * k] AS DOUBLE)) FOR k IN range(0, 8)], lambda s, x: s + x) FOR c IN range(1, 9)] AS a FROM embeddings) e) f)"""


def leaves_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.floor(F.col("doc_id") / 16).cast("bigint").alias("batch"),
        (F.col("doc_id") % 16).cast("bigint").alias("pos"),
        F.sha2("text", 256).alias("leaf"),
    )


LEAVES = """
leaves_v AS (
  SELECT CAST(floor(doc_id / 16) AS BIGINT) AS batch, CAST(doc_id % 16 AS BIGINT) AS pos, sha256(text) AS leaf
  FROM documents)"""


def rounded(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals) for c in columns})


def flow_columns(extra: list[str] | None = None) -> list[str]:
    return [*FLOW_IDENTITY, *(extra or FEATURE_COLUMNS)]
