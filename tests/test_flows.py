"""Flow assembly against hand cases and a packet-by-packet model."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions.packets import byte_entropy, entropy_class, port_profile
from flowspark.operators import filters, flows

S = 1_000_000
SYN, ACK, FIN, RST, PSH = 2, 16, 1, 4, 8
BACK = dict(src_ip="10.0.0.2", dst_ip="10.0.0.1", src_port=80, dst_port=40000)


def test_idle_timeout_splits_a_reused_tuple(packets):
    rows = packets((100, {}), (100, dict(src_port=40001)), (106, {}))
    table = flows.flow_table(flows.assemble_flows(rows, 5 * S, 120 * S))
    assert sorted((r.src_port, r.start_us // S) for r in table.collect()) == [(40000, 100), (40000, 106), (40001, 100)]


def test_gap_equal_to_timeout_breaks(packets):
    table = flows.flow_table(flows.assemble_flows(packets((0, {}), (5, {})), 5 * S, 120 * S))
    assert table.count() == 2


def test_handshake_and_direction(packets):
    rows = packets((0, dict(tcp_flags=SYN)), (1, dict(tcp_flags=SYN | ACK, **BACK)), (2, dict(tcp_flags=ACK)), (3, dict(tcp_flags=PSH | ACK)))
    cut = flows.assemble_flows(rows, 15 * S, 120 * S)
    for variant in ("sorted", "arrival"):
        r = flows.handshake(cut, flows.flow_features(cut, variant), variant).collect()[0]
        assert (r.fwd_packets, r.bwd_packets, r.handshake_complete, r.handshake_latency_us) == (3, 1, True, 2 * S)
        assert (r.duration_us, r.iat_mean_us, r.fwd_iat_mean_us, r.bytes_per_s) == (3 * S, S, 1.5 * S, 80.0)


def test_fin_both_ways_closes(packets):
    rows = packets((0, dict(tcp_flags=FIN)), (1, dict(tcp_flags=FIN, **BACK)), (2, {}))
    table = flows.flow_table(flows.assemble_flows(rows, 15 * S, 120 * S)).orderBy("start_us").collect()
    assert [(r.fwd_packets, r.bwd_packets) for r in table] == [(1, 1), (1, 0)]


def test_reset_closes_and_next_side_becomes_forward(packets):
    rows = packets((0, dict(tcp_flags=SYN)), (1, dict(tcp_flags=RST)), (2, BACK))
    table = flows.flow_table(flows.assemble_flows(rows, 15 * S, 120 * S)).orderBy("start_us").collect()
    assert [(r.src_ip, r.fwd_packets) for r in table] == [("10.0.0.1", 2), ("10.0.0.2", 1)]


def _greedy(rows, idle, active):
    """Packet by packet: the definition the operators must reproduce."""
    active_flows, done = {}, []
    for i, (t, over) in enumerate(rows):
        src = (over.get("src_ip", "10.0.0.1"), over.get("src_port", 40000))
        dst = (over.get("dst_ip", "10.0.0.2"), over.get("dst_port", 80))
        key, flags = frozenset((src, dst)), over.get("tcp_flags") or 0
        flow = active_flows.get(key)
        if flow and (t - flow["last"] >= idle or t - flow["start"] >= active):
            done.append(active_flows.pop(key))
            flow = None
        if flow is None:
            flow = active_flows[key] = dict(start=t, last=t, init=src, members=[], fins=set())
        flow["last"] = t
        flow["members"].append(i)
        if flags & FIN:
            flow["fins"].add(src == flow["init"])
        if flags & RST or len(flow["fins"]) == 2:
            done.append(active_flows.pop(key))
    return sorted(tuple(f["members"]) for f in [*done, *active_flows.values()])


@pytest.mark.parametrize("limit", [10_000, 20])
def test_against_packet_by_packet(packets, limit):
    """With a small limit, slices and the long-segment path do the same work."""
    rng, rows, t = random.Random(7), [], 0
    for _ in range(400):
        t += rng.choice([0.5, 1, 1, 2, 3, 9])
        over = dict(BACK) if rng.random() < 0.5 else {}
        if rng.random() < 0.2:
            over |= dict(src_port=40001) if not over else dict(dst_port=40001)
        over["tcp_flags"] = rng.choice([ACK, ACK, ACK, ACK, ACK, ACK, FIN, FIN | ACK, RST if rng.random() < 0.3 else ACK])
        rows.append((t, over))
    cut = flows.assemble_flows(packets(*rows), 8 * S, 25 * S, limit)
    got = cut.groupBy(*flows.FLOW).agg(F.array_sort(F.collect_list("seq")).alias("m")).collect()
    assert sorted(tuple(r.m) for r in got) == _greedy(rows, 8, 25)


def test_long_segment_without_any_break(packets):
    rows = [(i * 0.7, {}) for i in range(300)]
    cut = flows.assemble_flows(packets(*rows), 5 * S, 10 * S, 30)
    got = cut.groupBy(*flows.FLOW).agg(F.array_sort(F.collect_list("seq")).alias("m")).collect()
    assert sorted(tuple(r.m) for r in got) == _greedy(rows, 5, 10)


def test_entropy(spark):
    rows = spark.createDataFrame([(0, b""), (1, b"aaaa"), (2, bytes(range(256)))], "i int, b binary")
    got = {r.i: (r.e, r.c) for r in rows.select("i", byte_entropy("b").alias("e")).withColumn("c", entropy_class(F.col("e"))).collect()}
    assert got == {0: (0.0, "EMPTY"), 1: (0.0, "EMPTY"), 2: (8.0, "HIGH_ENCRYPTED_OR_PACKED")}


def test_flow_entropy_budget(packets):
    rows = packets((0, dict(payload=b"a" * 4000)), (1, dict(payload=b"b" * 4000, **BACK)))
    row = flows.flow_entropy(flows.assemble_flows(rows, 15 * S, 120 * S)).collect()[0]
    share = 4000 / 4096
    import math

    assert row.payload_bytes == 4096
    assert row.payload_entropy == pytest.approx(-share * math.log2(share) - (1 - share) * math.log2(1 - share))


def test_dns_kept_with_filter_off_although_listed(packets):
    dns = packets((0, dict(protocol="udp", dst_port=53, length=80)))
    assert filters.filter_noise(dns, filter_dns=False).count() == 1
    assert filters.filter_noise(dns).count() == 0


def test_pruner_cases(packets):
    rows = packets(
        (0, dict(protocol="udp", dst_port=123)), (1, dict(protocol="arp")), (2, dict(protocol="udp", dst_port=53, length=80)), (3, dict(dst_port=445))
    )
    assert [r.dst_port for r in filters.prune_background(rows).collect()] == [445]
    stats = filters.prune_stats(rows).collect()[0]
    assert (stats.examined, stats.pruned, stats.retained, stats.prune_ratio) == (4, 3, 1, 0.75)


def test_port_profile(spark):
    rows = spark.createDataFrame([(50000, 445), (50000, 50001)], "s int, d int").select("s", port_profile(F.col("s"), F.col("d")).alias("p"))
    got = [r.p.asDict() for r in rows.orderBy("p.dst_tier").collect()]
    assert got[0]["suspicious_ephemeral"] and got[0]["service"] == "UNKNOWN" and not got[0]["client_to_server"]
    assert got[1]["service"] == "SMB" and got[1]["client_to_server"] and not got[1]["suspicious_ephemeral"]
