"""Rules, fusion, blocks and the response gate on hand cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions.numeric import signed_expm1, signed_log1p, wilson
from flowspark.operators import respond, rules
from flowspark.schemas import FEATURE_COLUMNS

S = 1_000_000
BASE = dict.fromkeys(FEATURE_COLUMNS, 0.0) | dict(
    src_ip="a", dst_ip="b", src_port=40000, dst_port=80, protocol="tcp", start_us=0, syn_count=0, fwd_packets=1, bwd_packets=1, avg_packet_size=500.0, down_up_ratio=1.0
)


@pytest.fixture(scope="module")
def flows(spark):
    def make(*rows):
        full = [BASE | r for r in rows]
        types = {str: "string", int: "bigint", float: "double"}
        names = list(BASE)
        schema = ", ".join(f"{n} {'double' if n in FEATURE_COLUMNS and not n.endswith('packets') else types[type(BASE[n])]}" for n in names)
        return spark.createDataFrame([tuple(float(r[n]) if n in FEATURE_COLUMNS and not n.endswith("packets") else r[n] for n in names) for r in full], schema)

    return make


def test_syn_flood_and_scan(flows):
    flood = flows(dict(fwd_packets=20, bwd_packets=0, syn_count=20, avg_packet_size=60.0, down_up_ratio=0.0))
    row = rules.evaluate_rules(flood).first()
    assert row.rule_threat == "TCP_SYN_FLOOD" and row.rule_confidence > 0.85
    scan = flows(*[dict(dst_port=100 + i, start_us=i * S) for i in range(7)])
    got = [r.rule_threat for r in rules.evaluate_rules(scan, ports=5).orderBy("start_us").collect()]
    assert got == [None] * 4 + ["PORT_SCAN"] * 3


def test_other_rules(flows):
    cases = flows(
        dict(src_ip="u", protocol="udp", fwd_packets=10, bwd_packets=0, packets_per_s=100.0),
        dict(src_ip="s", duration_us=16e6, fwd_len_mean=60.0, bytes_per_s=49.0, fwd_iat_mean_us=3_000_001.0),
        dict(src_ip="v", fwd_packets=20, bytes_per_s=50_000_001.0),
        dict(src_ip="w", duration_us=15e6, fwd_len_mean=60.0, bytes_per_s=49.0, fwd_iat_mean_us=3_000_001.0),
    )
    got = {r.src_ip: r.rule_threat for r in rules.evaluate_rules(cases).collect()}
    assert got == dict(u="UDP_FLOOD", s="SLOWLORIS_DOS", v="VOLUMETRIC_DDoS", w=None)


@pytest.mark.parametrize("limit", [7, 10_000])
def test_sliding_rules_against_brute_force(flows, limit):
    rng = random.Random(3)
    rows = [
        dict(src_ip=rng.choice(["hot", "hot", "hot", "x"]), dst_port=rng.choice([0, 1, 2, 3, 4, 5, 6]), start_us=rng.randint(0, 60) * S, dst_ip=str(i),
             bwd_packets=rng.choice([0, 0, 1]), down_up_ratio=0.0, syn_count=1, avg_packet_size=60.0)
        for i in range(150)
    ]
    got = rules.syn_flood(rules.port_scan(flows(*rows), 10 * S, 6, limit=limit), 10 * S, limit=limit).collect()
    assert len(got) == len(rows)

    def within(r, t, src):
        return r["src_ip"] == src and t - 10 * S <= r["start_us"] <= t

    scans = {}
    for r in rows:
        ports = {q["dst_port"] for q in rows if within(q, r["start_us"], r["src_ip"]) and q["dst_port"] > 0}
        scans[r["dst_ip"]] = len(ports) if r["dst_port"] > 0 else 0
    candidate = {r["dst_ip"]: r["bwd_packets"] == 0 and not (r["dst_port"] > 0 and scans[r["dst_ip"]] >= 6) for r in rows}
    for g in got:
        assert g.scan_ports == scans[g.dst_ip]
        expected = sum(candidate[q["dst_ip"]] for q in rows if within(q, g.start_us, g.src_ip))
        assert g.syn_flows == (expected if candidate[g.dst_ip] else 0)
        assert g.syn_flood == (candidate[g.dst_ip] and expected >= 5)


def test_fusion_sources(flows):
    rows = rules.evaluate_rules(flows(dict(src_ip="u", protocol="udp", fwd_packets=10, bwd_packets=0, packets_per_s=100.0), dict(src_ip="n")))
    both = rows.crossJoin(rows.sparkSession.createDataFrame([(0.1,), (0.95,)], "model_p double")).withColumn("model_stage", F.lit(4))
    got = {(r.src_ip, r.model_p): (r.detection_source, r.threat_type, r.final_score) for r in rules.fuse(both).collect()}
    assert got[("u", 0.1)] == ("HEURISTIC_INSTANT", "UDP_FLOOD", 0.93)
    assert got[("u", 0.95)] == ("DUAL_CONFIRMED", "UDP_FLOOD", 0.95)
    assert got[("n", 0.95)] == ("MODEL", "GRAPH_ANOMALY_LATERAL_MOVEMENT", 0.95)
    assert got[("n", 0.1)][0] == "BENIGN"


def test_blocks_refresh_expire_and_unblock(spark):
    hits = spark.createDataFrame([("a", 0), ("a", 200 * S), ("a", 600 * S), ("b", 0), ("b", 100 * S)], "ip string, ts_us bigint")
    lifts = spark.createDataFrame([("b", 50 * S)], "ip string, ts_us bigint")
    for limit in (10_000, 2):
        blocks = respond.block_intervals(hits, lifts, limit=limit)
        got = sorted((r.ip, r.blocked_us // S, r.expires_us // S, r.hits) for r in blocks.collect())
        assert got == [("a", 0, 500, 2), ("a", 600, 900, 1), ("b", 0, 50, 1), ("b", 100, 400, 1)]
    probes = spark.createDataFrame([(1, "a", 499 * S), (2, "a", 500 * S), (3, "b", 60 * S), (4, "c", 1)], "probe_id int, ip string, ts_us bigint")
    assert {r.probe_id: r.blocked for r in respond.is_blocked(probes, blocks).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert respond.active_blocks(blocks, 100 * S).count() == 2


def _alert(**over):
    base = dict(src_ip="1", dst_ip="2", attack_p=0.99, model_p=0.99, confirmed=True, stage_validated=True, calibrated=True,
                stage_set=["lateral_movement"], stage_name="lateral_movement")
    return base | over


def test_response_truth_table(spark):
    schema = "src_ip string, dst_ip string, attack_p double, model_p double, confirmed boolean, stage_validated boolean, calibrated boolean, stage_set array<string>, stage_name string"
    cases = [
        (_alert(), 2), (_alert(stage_set=[]), 0), (_alert(stage_set=["benign", "lateral_movement"]), 0), (_alert(stage_set=["stage_9"]), 0),
        (_alert(stage_set=["impact"], stage_name="impact"), 0), (_alert(stage_validated=False), 0), (_alert(model_p=0.2), 0), (_alert(attack_p=0.85), 0),
        (_alert(stage_set=["command_and_control"], stage_name="command_and_control"), 1),
        (_alert(stage_set=["command_and_control", "lateral_movement"]), 1), (_alert(calibrated=None), 0),
    ]
    for alert, expected in cases:
        frame = spark.createDataFrame([tuple(alert.values())], schema)
        assert respond.plan_actions(frame).count() == expected, alert
    planned = respond.plan_actions(spark.createDataFrame([tuple(_alert().values())], schema), "iptables").orderBy("action_type").collect()
    assert planned[1].command == ["iptables", "-I", "INPUT", "-s", "1", "-j", "DROP"]
    decoy = spark.range(1).select(respond.plan_command("DECOY_REROUTE", F.lit("9.9.9.9"), "iptables", F.lit(80)).alias("c")).first().c
    assert decoy[-2:] == ["--to-ports", "8088"] and "80" in decoy


def test_incident_numbers(spark):
    rows = spark.createDataFrame([(5 * S, 0.9), (3 * S, 0.6), (1 * S, 0.1)], "ts_us bigint, final_score double")
    got = respond.number_incidents(respond.respond(rows), ["ts_us"]).orderBy("incident_no").collect()
    assert [(r.incident_id, r.action) for r in got] == [("INC-3-0001", "ALERT"), ("INC-5-0002", "BLOCK_IP")]
    assert respond.recent_incidents(respond.number_incidents(respond.respond(rows), ["ts_us"]), 0).count() == 0


def test_numeric_helpers(spark):
    r = spark.range(1).select(
        wilson(F.lit(0), F.lit(100)).alias("w"), wilson(F.lit(0), F.lit(0)).alias("none"), signed_log1p(F.lit(None).cast("double")).alias("unknown"),
        signed_expm1(signed_log1p(F.lit(-12.5))).alias("back"), signed_log1p(F.lit(1e300)).alias("clipped"),
    ).first()
    assert 0.03 < r.w.high < 0.04 and r.w.low == pytest.approx(0, abs=1e-15) and r.none is None and r.unknown is None
    assert r.back == pytest.approx(-12.5) and r.clipped == 100.0
