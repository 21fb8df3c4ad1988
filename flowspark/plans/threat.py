"""Detection rules, fusion, incidents, blocks and response plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions.numeric import argmax, stage_name
from flowspark.operators import flows as fl
from flowspark.operators import respond as rs
from flowspark.operators import rules
from flowspark.plans import views as v
from flowspark.schemas import STAGES
from flowspark.session import materialized

TTL = 6 * v.HOUR


def _ruled(spark, sf, flows=None):
    flows = v.flows_v(spark, sf) if flows is None else flows
    return rules.evaluate_rules(flows, v.SCAN_WINDOW, v.SCAN_PORTS)


def _fused(spark, sf, flows=None):
    return materialized(rules.fuse(v.model_scored(_ruled(spark, sf, flows))), "fused")


def _incidents(spark, sf):
    alerts = _fused(spark, sf).withColumn("ts_us", F.col("start_us"))
    acted = rs.respond(alerts)
    return rs.number_incidents(acted, ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"])


def _hits(spark, sf, flows=None):
    blocked = rs.respond(_fused(spark, sf, flows)).where("action = 'BLOCK_IP'")
    return blocked.select(F.col("src_ip").alias("ip"), F.col("start_us").alias("ts_us"))


def _unblocks(flows):
    """Manual unblocks: a host is released when it is seen resetting a flow of its own."""
    return flows.where("rst_count > 0").select(F.col("src_ip").alias("ip"), F.col("last_us").alias("ts_us")).distinct()


def port_scan_rule(spark, sf):
    rows = rules.port_scan(v.flows_v(spark, sf), v.SCAN_WINDOW, v.SCAN_PORTS)
    return rows.select(*v.FLOW_IDENTITY, "scan_ports", "port_scan")


def syn_flood_rule(spark, sf):
    rows = rules.syn_flood(rules.port_scan(v.flows_v(spark, sf), v.SCAN_WINDOW, v.SCAN_PORTS), v.SCAN_WINDOW)
    return rows.select(*v.FLOW_IDENTITY, "syn_flows", "syn_flood")


def flow_rules(spark, sf):
    """The three rules on single flows, side by side."""
    return v.flows_v(spark, sf).select(
        *v.FLOW_IDENTITY,
        rules.udp_flood().alias("udp_flood"),
        rules.slowloris().alias("slowloris"),
        rules.volumetric().alias("volumetric"),
    )


def rule_engine(spark, sf):
    rows = _ruled(spark, sf)
    return rows.select(*v.FLOW_IDENTITY, "rule_threat", F.round("rule_confidence", 6).alias("rule_confidence"), "rule_reason")


def rule_verdict_counts(spark, sf):
    threat = F.coalesce("rule_threat", F.lit("BENIGN")).alias("threat_type")
    return _ruled(spark, sf).groupBy(threat).agg(F.count(F.lit(1)).alias("flows"), F.countDistinct("src_ip").alias("sources"))


def hybrid_fusion(spark, sf):
    rows = _fused(spark, sf)
    return rows.select(
        *v.FLOW_IDENTITY, F.round("final_score", 6).alias("final_score"), "is_attack", "detection_source", "threat_type", "stage_name"
    )


def evidence_boost(spark, sf):
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    rows = fl.flow_table(assembled).join(fl.flow_entropy(assembled, largest=largest), fl.FLOW)
    boosted = rules.apply_evidence_boost(v.model_scored(rows))
    return boosted.select(*v.FLOW_IDENTITY, "heuristic_p", "attack_p", "stage", "stage_name")


def document_evidence_boost(spark, sf):
    """The same boost over whole document payloads, which reach other entropy levels."""
    from flowspark.functions.packets import byte_entropy

    docs = v.table(spark, sf, "documents").withColumn("payload", F.col("text").cast("binary"))
    rows = docs.select(
        "doc_id",
        (F.round(byte_entropy("payload"), 6) + F.lit(2.5)).alias("payload_entropy"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        (F.col("doc_id") % 7).alias("syn_count"),
        ((F.col("doc_id") % 7) / (F.col("doc_id") % 3 + 1)).alias("syn_ack_ratio"),
        (F.col("n_chars") % 100 / F.lit(100.0)).alias("model_p"),
        (F.col("n_chars") % 10).cast("int").alias("model_stage"),
    )
    return rules.apply_evidence_boost(rows).select("doc_id", "heuristic_p", "attack_p", "stage", "stage_name")


def incidents(spark, sf):
    return _incidents(spark, sf).select(
        "incident_no", "incident_id", "action", *v.FLOW_IDENTITY, "threat_type", F.round("final_score", 6).alias("final_score")
    )


def latest_incidents(spark, sf):
    return rs.recent_incidents(_incidents(spark, sf), 50).select("incident_no", "incident_id", "action", "src_ip", "dst_ip")


def block_register(spark, sf):
    flows = v.flows_v(spark, sf)
    return rs.block_intervals(_hits(spark, sf, flows), _unblocks(flows), TTL)


def blocked_flows(spark, sf):
    """Flows that start while their source is blocked."""
    flows = v.flows_v(spark, sf)
    blocks = rs.block_intervals(_hits(spark, sf, flows), None, TTL)
    probes = flows.select(
        F.concat_ws("|", *v.FLOW_IDENTITY).alias("probe_id"), F.col("src_ip").alias("ip"), F.col("start_us").alias("ts_us")
    )
    # Intervals are for the source's earlier hits; the probe's own hit opens at its own time.
    return rs.is_blocked(probes.withColumn("ts_us", F.col("ts_us") - 1), blocks)


def active_block_count(spark, sf):
    """Active blocks at each whole day, by summing interval starts and ends."""
    blocks = rs.block_intervals(_hits(spark, sf), None, TTL)
    day = F.lit(24 * v.HOUR)
    first, last = F.ceil(F.col("blocked_us") / day), F.floor((F.col("expires_us") - 1) / day)
    days = blocks.where(first <= last).select(F.explode(F.sequence(first, last)).alias("day"), "ip")
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("active"))


def _alert_rows(spark, sf):
    """Alerts with a stage set, for the response gate: sets derive from the flow itself."""
    fused = _fused(spark, sf).where("is_attack")
    names = F.array(*map(F.lit, STAGES))
    first, second = F.get(names, F.col("model_stage")), F.get(names, (F.col("fwd_packets") % 8).cast("int"))
    return fused.withColumns(
        {
            "attack_p": F.col("final_score"),
            "stage_set": F.array_distinct(F.array(first, second)),
            "confirmed": F.col("dst_port") != 443,
            "stage_validated": F.lit(True),
            "calibrated": F.col("src_port") != 80,
        }
    )


def response_gate(spark, sf):
    rows = _alert_rows(spark, sf)
    return rows.select(*v.FLOW_IDENTITY, F.array_join("stage_set", ",").alias("stages"), rs.gate_response().alias("allowed"))


def response_plan(spark, sf):
    planned = rs.plan_actions(_alert_rows(spark, sf), "nft")
    return planned.select(*v.FLOW_IDENTITY, "action_type", "target_ip", F.array_join("command", " ").alias("command"))


def stage_names(spark, sf):
    """Stage argmax and name over the probability rows."""
    rows = v.stage_probs_v(spark, sf).withColumn("stage", argmax(F.col("probs")))
    return rows.select(
        "vec_id", "stage", stage_name(F.col("stage")).alias("stage_name"), stage_name(F.col("stage") + 4, "stage").alias("shifted")
    )


def cycle_totals(spark, sf):
    """Flows, alerts and blocks per window."""
    cycle = F.floor(F.col("start_us") / v.WINDOW).alias("cycle")
    flows = v.flows_v(spark, sf)
    fused = _fused(spark, sf, flows).withColumn("cycle", F.floor(F.col("start_us") / v.WINDOW))
    return rs.cycle_summary(flows.select(cycle), rs.respond(fused), ["cycle"])


QUERIES = {
    f.__name__: f
    for f in (
        port_scan_rule,
        syn_flood_rule,
        flow_rules,
        rule_engine,
        rule_verdict_counts,
        hybrid_fusion,
        evidence_boost,
        document_evidence_boost,
        incidents,
        latest_incidents,
        block_register,
        blocked_flows,
        active_block_count,
        response_gate,
        response_plan,
        stage_names,
        cycle_totals,
    )
}

_ID = ", ".join(v.FLOW_IDENTITY)
_FID = ", ".join(f"f.{c}" for c in v.FLOW_IDENTITY)
_W = v.SCAN_WINDOW
SCAN_CTE = f"""
scan AS (SELECT f.*, CASE WHEN f.dst_port > 0 THEN (SELECT count(DISTINCT g.dst_port) FROM flows_v g WHERE g.src_ip = f.src_ip
    AND g.dst_port > 0 AND g.start_us BETWEEN f.start_us - {_W} AND f.start_us) ELSE 0 END AS scan_ports FROM flows_v f),
syn AS (SELECT *, scan_ports >= {v.SCAN_PORTS} AS port_scan, protocol = 'tcp' AND syn_count > 0 AND bwd_packets = 0 AND down_up_ratio = 0
    AND avg_packet_size <= 70.0 AND scan_ports < {v.SCAN_PORTS} AS candidate FROM scan),
syns AS (SELECT s.*, CASE WHEN candidate THEN (SELECT count(*) FROM syn g WHERE g.candidate AND g.src_ip = s.src_ip
    AND g.start_us BETWEEN s.start_us - {_W} AND s.start_us) ELSE 0 END AS syn_flows FROM syn s)"""
_UDP = "protocol = 'udp' AND fwd_packets >= 10 AND bwd_packets = 0 AND packets_per_s >= 100"
_SLOW = "protocol = 'tcp' AND duration_us > 15000000 AND fwd_len_mean <= 60 AND bytes_per_s < 50.0 AND fwd_iat_mean_us > 3000000"
_VOLUME = "fwd_packets >= 20 AND (packets_per_s > 10000 OR bytes_per_s > 50000000)"
_FLOOD = "candidate AND (fwd_packets >= 3 OR syn_flows >= 5)"
RULED_CTE = f"""{SCAN_CTE},
ruled AS (SELECT *, CASE WHEN port_scan THEN 'PORT_SCAN' WHEN {_FLOOD} THEN 'TCP_SYN_FLOOD' WHEN {_UDP} THEN 'UDP_FLOOD'
    WHEN {_SLOW} THEN 'SLOWLORIS_DOS' WHEN {_VOLUME} THEN 'VOLUMETRIC_DDoS' END AS rule_threat,
  CAST(CASE WHEN port_scan THEN 0.96 WHEN {_FLOOD} THEN least(0.98, 0.75 + 0.04 * least(greatest(fwd_packets, syn_flows), 6))
    WHEN {_UDP} THEN 0.93 WHEN {_SLOW} THEN 0.91 WHEN {_VOLUME} THEN 0.95 END AS DOUBLE) AS rule_confidence FROM syns)"""
_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
FUSED_CTE = f"""{RULED_CTE},
fused AS (SELECT *, greatest(coalesce(rule_confidence, 0.0), model_p) AS final_score,
    greatest(coalesce(rule_confidence, 0.0), model_p) >= 0.5 AS is_attack, ({_STAGE_LIST})[model_stage + 1] AS stage_name,
    CASE WHEN rule_threat IS NOT NULL AND model_p >= 0.5 THEN 'DUAL_CONFIRMED' WHEN rule_threat IS NOT NULL THEN 'HEURISTIC_INSTANT'
      WHEN model_p >= 0.5 THEN 'MODEL' ELSE 'BENIGN' END AS detection_source,
    CASE WHEN rule_threat IS NOT NULL THEN rule_threat
      WHEN model_p >= 0.5 THEN 'GRAPH_ANOMALY_' || upper(({_STAGE_LIST})[model_stage + 1]) ELSE 'BENIGN' END AS threat_type
  FROM (SELECT *, CAST((fwd_bytes + bwd_bytes) % 101 AS DOUBLE) / 100.0 AS model_p,
    CAST((fwd_packets + bwd_packets + dst_port) % 8 AS INT) AS model_stage FROM ruled) r)"""
_HITS = "hits AS (SELECT DISTINCT src_ip AS ip, start_us AS ts_us FROM fused WHERE final_score >= 0.85)"
_ACTED = """acted AS (SELECT *, CASE WHEN final_score >= 0.85 THEN 'BLOCK_IP' ELSE 'ALERT' END AS action FROM fused WHERE final_score >= 0.5)"""
_NUMBERED = f"""{_ACTED}, numbered AS (SELECT *, row_number() OVER (ORDER BY start_us, src_ip, dst_ip, src_port, dst_port, protocol) AS incident_no FROM acted),
named AS (SELECT *, 'INC-' || CAST(start_us // 1000000 AS VARCHAR) || '-' || CASE WHEN incident_no < 10000
    THEN lpad(CAST(incident_no AS VARCHAR), 4, '0') ELSE CAST(incident_no AS VARCHAR) END AS incident_id FROM numbered)"""
# Blocks by gaps and islands without unblocks.
_BLOCKS = f"""{_HITS}, opened AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY ip ORDER BY ts_us) + {TTL} THEN 0 ELSE 1 END AS o FROM hits),
islands AS (SELECT *, sum(o) OVER (PARTITION BY ip ORDER BY ts_us) AS island FROM opened),
blocks AS (SELECT ip, min(ts_us) AS blocked_us, max(ts_us) + {TTL} AS expires_us FROM islands GROUP BY ip, island)"""
# With unblocks: walk every address event by event.
_BLOCK_WALK = f"""{_HITS.replace("SELECT DISTINCT", "SELECT").replace("final_score >= 0.85", "final_score >= 0.85")},
events_b AS (SELECT ip, ts_us, 1 AS hit, count(*) AS n FROM hits GROUP BY ip, ts_us
  UNION ALL SELECT DISTINCT src_ip, last_us, 0, 0 FROM flows_v WHERE rst_count > 0),
numbered_b AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, hit) AS rn FROM events_b),
block_walk AS (
  SELECT ip, rn, CASE WHEN hit = 1 THEN ts_us END AS blocked_us, CASE WHEN hit = 1 THEN ts_us END AS last_hit_us,
    CASE WHEN hit = 1 THEN ts_us + {TTL} END AS expires_us, n AS hits FROM numbered_b WHERE rn = 1
  UNION ALL
  SELECT e.ip, e.rn,
    CASE WHEN hit = 1 AND (w.expires_us IS NULL OR e.ts_us >= w.expires_us) THEN e.ts_us ELSE w.blocked_us END,
    CASE WHEN hit = 1 THEN e.ts_us ELSE w.last_hit_us END,
    CASE WHEN hit = 1 THEN e.ts_us + {TTL} ELSE least(w.expires_us, e.ts_us) END,
    CASE WHEN hit = 0 THEN w.hits WHEN w.expires_us IS NULL OR e.ts_us >= w.expires_us THEN e.n ELSE w.hits + e.n END
  FROM block_walk w JOIN numbered_b e ON e.ip = w.ip AND e.rn = w.rn + 1)"""
_F = v.FLOW_CTES
_RULE_REASON = f"""CASE WHEN port_scan THEN format('Contacted {{}} different ports in {{:.1f}} s.', scan_ports, {_W} / 1000000.0)
  WHEN {_FLOOD} THEN format('{{}} SYN packets without answer or payload.', greatest(fwd_packets, syn_flows))
  WHEN {_UDP} THEN format('One-way UDP at {{:.0f}} packets/s, nothing came back.', packets_per_s)
  WHEN {_SLOW} THEN format('Open for {{:.1f}} s at only {{:.1f}} bytes/s.', duration_us / 1e6, bytes_per_s)
  WHEN {_VOLUME} THEN format('Sends {{:.0f}} packets/s, {{:.1f}} MB/s.', packets_per_s, bytes_per_s / 1e6) END"""
_ALERT_ROWS = f"""alert_rows AS (SELECT *, ({_STAGE_LIST})[model_stage + 1] AS s1, ({_STAGE_LIST})[CAST(fwd_packets % 8 AS INT) + 1] AS s2
  FROM fused WHERE is_attack),
gated AS (SELECT *, CASE WHEN s1 = s2 THEN s1 ELSE s1 || ',' || s2 END AS stages,
  dst_port <> 443 AND src_port <> 80 AND final_score > 0.85 AND model_p > 0.85
    AND s1 IN ('lateral_movement', 'command_and_control') AND s2 IN ('lateral_movement', 'command_and_control') AS allowed FROM alert_rows)"""

ORACLE = {
    "port_scan_rule": f"{_F}, {SCAN_CTE} SELECT {_ID}, scan_ports, port_scan FROM syn",
    "syn_flood_rule": f"{_F}, {SCAN_CTE} SELECT {_ID}, syn_flows, {_FLOOD} AS syn_flood FROM syns",
    "flow_rules": f"{_F} SELECT {_ID}, {_UDP} AS udp_flood, {_SLOW} AS slowloris, {_VOLUME} AS volumetric FROM flows_v",
    "rule_engine": f"""{_F}, {RULED_CTE} SELECT {_ID}, rule_threat, round(rule_confidence, 6) AS rule_confidence,
        {_RULE_REASON} AS rule_reason FROM ruled""",
    "rule_verdict_counts": f"""{_F}, {RULED_CTE} SELECT coalesce(rule_threat, 'BENIGN') AS threat_type, count(*) AS flows,
        count(DISTINCT src_ip) AS sources FROM ruled GROUP BY 1""",
    "hybrid_fusion": f"""{_F}, {FUSED_CTE} SELECT {_ID}, round(final_score, 6) AS final_score, is_attack, detection_source, threat_type,
        stage_name FROM fused""",
    "evidence_boost": f"""{_F}, {v.MODEL_SCORED}, b AS (SELECT *, CASE WHEN syn_ack_ratio >= 3.0 AND syn_count >= 5 THEN 0.89 ELSE 0.0 END::DOUBLE AS heuristic_p
          FROM scored_flows)
        SELECT {_ID}, heuristic_p, greatest(model_p, heuristic_p) AS attack_p,
          CAST(CASE WHEN heuristic_p > model_p THEN 1 ELSE model_stage END AS INT) AS stage,
          ({_STAGE_LIST})[CASE WHEN heuristic_p > model_p THEN 1 ELSE model_stage END + 1] AS stage_name FROM b""",
    "document_evidence_boost": f"""WITH h AS (SELECT doc_id, n_chars, hex(text) AS h FROM documents),
        b AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS b, count(*) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM h) GROUP BY 1, 2),
        e AS (SELECT doc_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 2.5 AS entropy, sum(c) AS n FROM b GROUP BY 1),
        r AS (SELECT doc_id, entropy >= 7.0 AND n >= 64 AS packed, doc_id % 7 >= 5 AND (doc_id % 7) / (doc_id % 3 + 1) >= 3.0 AS half_open,
          CAST(n_chars % 100 AS DOUBLE) / 100.0 AS model_p, CAST(n_chars % 10 AS INT) AS model_stage FROM documents JOIN e USING (doc_id)),
        x AS (SELECT *, greatest(CASE WHEN packed THEN 0.92 ELSE 0.0 END, CASE WHEN half_open THEN 0.89 ELSE 0.0 END)::DOUBLE AS heuristic_p FROM r),
        y AS (SELECT *, CASE WHEN heuristic_p > model_p THEN CASE WHEN half_open THEN 1 ELSE 2 END ELSE model_stage END AS stage FROM x)
        SELECT doc_id, heuristic_p, greatest(model_p, heuristic_p) AS attack_p, stage,
          coalesce(({_STAGE_LIST})[stage + 1], 'stage_' || stage) AS stage_name FROM y""",
    "incidents": f"""{_F}, {FUSED_CTE}, {_NUMBERED} SELECT incident_no, incident_id, action, {_ID}, threat_type,
        round(final_score, 6) AS final_score FROM named""",
    "latest_incidents": f"""{_F}, {FUSED_CTE}, {_NUMBERED} SELECT incident_no, incident_id, action, src_ip, dst_ip FROM named
        ORDER BY incident_no DESC LIMIT 50""",
    "block_register": f"""{_F}, {FUSED_CTE}, {_BLOCK_WALK} SELECT ip, blocked_us, max(last_hit_us) AS last_hit_us,
        CAST(max(hits) AS BIGINT) AS hits, arg_max(expires_us, rn) AS expires_us FROM block_walk
        WHERE blocked_us IS NOT NULL GROUP BY ip, blocked_us""",
    "blocked_flows": f"""{_F}, {FUSED_CTE}, {_BLOCKS} SELECT concat_ws('|', {_FID}) AS probe_id, f.src_ip AS ip, f.start_us - 1 AS ts_us,
        EXISTS (SELECT 1 FROM blocks b WHERE b.ip = f.src_ip AND b.blocked_us <= f.start_us - 1 AND f.start_us - 1 < b.expires_us) AS blocked
        FROM flows_v f""",
    "active_block_count": f"""{_F}, {FUSED_CTE}, {_BLOCKS}, days AS (SELECT unnest(range(0, 40000)) AS day)
        SELECT day, count(*) AS active FROM days JOIN blocks ON blocked_us <= day * {24 * v.HOUR} AND day * {24 * v.HOUR} < expires_us GROUP BY 1""",
    "response_gate": f"{_F}, {FUSED_CTE}, {_ALERT_ROWS} SELECT {_ID}, stages, allowed FROM gated",
    "response_plan": f"""{_F}, {FUSED_CTE}, {_ALERT_ROWS} SELECT {_ID}, 'PACKET_DROP' AS action_type, src_ip AS target_ip,
          'nft add rule inet filter input ip saddr ' || src_ip || ' drop' AS command FROM gated WHERE allowed
        UNION ALL SELECT {_ID}, 'HOST_ISOLATE', dst_ip,
          'nft add rule inet filter forward ip saddr ' || dst_ip || ' ip daddr != 192.168.1.0/24 drop'
        FROM gated WHERE allowed AND stages = 'lateral_movement'""",
    "stage_names": f"""WITH {v.STAGE_PROBS}, s AS (SELECT vec_id, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS stage FROM stage_probs_v)
        SELECT vec_id, stage, coalesce(({_STAGE_LIST})[stage + 1], 'unmapped_' || stage) AS stage_name,
          coalesce(({_STAGE_LIST})[stage + 5], 'stage_' || (stage + 4)) AS shifted FROM s""",
    "cycle_totals": f"""{_F}, {FUSED_CTE}, {_ACTED}, a AS (SELECT start_us // {v.WINDOW} AS cycle, count(*) AS alerts,
          count(*) FILTER (action = 'BLOCK_IP') AS blocks, arg_max(threat_type, (start_us, src_ip, dst_ip, src_port)) AS last_threat FROM acted GROUP BY 1),
        p AS (SELECT start_us // {v.WINDOW} AS cycle, count(*) AS flows FROM flows_v GROUP BY 1)
        SELECT cycle, flows, coalesce(alerts, 0) AS alerts, coalesce(blocks, 0) AS blocks, last_threat FROM p LEFT JOIN a USING (cycle)""",
}
