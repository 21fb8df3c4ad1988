"""Streams must give the batch result, however the input is cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evidence, flows, respond, rules
from flowspark.operators import ledger as lg
from flowspark.schemas import FEATURE_COLUMNS, PACKET
from flowspark.session import fresh_dir
from flowspark.streaming import evidence as se
from flowspark.streaming import feed
from flowspark.streaming import flows as sf
from flowspark.streaming import ledger as sl
from flowspark.streaming import source, state

S = 1_000_000
FAR = 4_000_000_000 * S
COLUMNS = ["src_ip", "dst_ip", "src_port", "start_us", "last_us", "fwd_packets", "bwd_packets", "fwd_bytes", "syn_count", "syn_ack_count", "ack_count", "rst_count", "fin_count"]


def _land(spark, frame, path, parts, order):
    """Write ``parts`` consecutive files, one after another."""
    rows = frame.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], frame.schema).coalesce(1).write.mode("append").parquet(path)


def _traffic(packets):
    rng, rows, t = random.Random(11), [], 1000.0
    for _ in range(250):
        t += rng.choice([0.5, 1, 2, 6])
        back = dict(src_ip="10.0.0.2", dst_ip="10.0.0.1", src_port=80, dst_port=40000)
        over = dict(back) if rng.random() < 0.5 else {}
        if rng.random() < 0.3:
            over |= dict(dst_port=40001) if over else dict(src_port=40001)
        rows.append((t, over | dict(tcp_flags=rng.choice([16, 16, 2, 18, 1, 17, 16, 4]))))
    return packets(*rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_flow_stream_equals_batch(spark, packets, parts):
    frame = _traffic(packets)
    path = fresh_dir(spark, "landed")
    _land(spark, frame, path, parts, "ts_us")
    source.heartbeat(spark, FAR).coalesce(1).write.mode("append").parquet(path)
    stream = source.stream_packets(spark, path, files_per_trigger=1)
    got = source.drain(sf.stream_flows(stream, 8 * S, 25 * S), "flows").select(*COLUMNS)
    want = flows.flow_table(flows.assemble_flows(frame, 8 * S, 25 * S)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _disordered(spark, frame, path, time, delay, parts, seed=5):
    """Rows land up to ``delay`` late, in ``parts`` files, each in any order."""
    rng = random.Random(seed)
    rows = sorted((r[time] + rng.randrange(delay), i, r) for i, r in enumerate(frame.collect()))
    first, span = rows[0][0], rows[-1][0] - rows[0][0] + 1
    for k in range(parts):
        part = [r for at, _, r in rows if (at - first) * parts // span == k]
        rng.shuffle(part)
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(path)


def test_disordered_packets_give_the_batch_flows_windows_and_verdicts(spark, packets):
    """Flows, features, handshakes, closed windows and rules behind one disordered packet stream."""
    frame = _traffic(packets)
    path = fresh_dir(spark, "landed")
    _disordered(spark, frame, path, "ts_us", 6 * S, 4)
    stream = lambda: sf.stream_flows(source.stream_packets(spark, path, files_per_trigger=1), 8 * S, 25 * S, 6 * S, buckets=3)
    table = flows.flow_features(flows.assemble_flows(frame, 8 * S, 25 * S))
    windows = {r.window: tuple(r) for r in source.drain(sf.stream_flow_windows(stream(), 15 * S, 8 * S), "windows").collect()}
    latest = frame.agg(F.max("ts_us")).first()[0] - 6 * S
    ends = table.groupBy(F.floor(F.col("last_us") / (15 * S)).alias("window")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum(F.col("fwd_packets") + F.col("bwd_packets")).alias("packets"), F.max("last_us").alias("latest_us")
    )
    assert windows == {r.window: tuple(r) for r in ends.collect() if (r.window + 1) * 15 * S + 8 * S <= latest}
    assert len(windows) > 10

    source.heartbeat(spark, FAR).coalesce(1).write.mode("append").parquet(path)
    extra = ["handshake_complete", "handshake_latency_us", *[c for c in FEATURE_COLUMNS if c not in COLUMNS]]
    seen = source.drain(stream().select(*COLUMNS, *extra), "flows").collect()
    want = flows.handshake(flows.assemble_flows(frame, 8 * S, 25 * S), table).select(*COLUMNS, *extra).collect()
    assert sorted(map(str, seen)) == sorted(map(str, want))
    assert any(r.handshake_complete for r in seen)

    verdicts = source.drain(state.stream_rules(stream(), 60 * S, 2, 25 * S), "verdicts")
    got = verdicts.select("src_ip", "src_port", "start_us", "scan_ports", "syn_flows", "rule_threat", "rule_reason").collect()
    batch = rules.evaluate_rules(table, 60 * S, 2)
    assert sorted(map(str, got)) == sorted(map(str, batch.select("src_ip", "src_port", "start_us", "scan_ports", "syn_flows", "rule_threat", "rule_reason").collect()))
    assert {r.rule_threat for r in got} > {None}


def test_rule_state_is_empty_after_the_last_heartbeat(spark):
    rows = [(f"10.0.0.{i % 3}", "b", 1, i % 5, "tcp", (i + 1) * S) for i in range(40)] + [("", "", 0, 0, source.HEARTBEAT, FAR)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_us bigint")
    path, out = fresh_dir(spark, "landed"), fresh_dir(spark, "scan")
    _land(spark, frame, path, 1, "start_us")
    stream = state.stream_port_scan(source.stream_packets(spark, path, frame.schema, files_per_trigger=1), 5 * S, 4)
    query = source.deliver(stream, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/{batch}"), f"{out}/progress")
    query.awaitTermination()
    assert spark.read.parquet(f"{out}/[0-9]*").count() == 40
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_streamed_evidence_equals_batch_and_keeps_bare_alerts(spark, packets):
    frame = _traffic(packets)
    rows = [(f"a{i}", "10.0.0.1", "10.0.0.2", 40000 + i % 2, 80, "tcp", (1000 + 9 * i) * S, (1003 + 9 * i) * S) for i in range(30)]
    rows += [("bare", "10.9.9.9", "10.0.0.2", 40000, 80, "tcp", 1010 * S, 1020 * S)]
    alerts = spark.createDataFrame(rows, "alert_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_us bigint, alert_us bigint")
    left, right = fresh_dir(spark, "alerts"), fresh_dir(spark, "packets")
    _disordered(spark, alerts, left, "alert_us", 6 * S, 3)
    _disordered(spark, frame, right, "ts_us", 6 * S, 3)
    spark.createDataFrame([(None, "", "", 0, 0, "", FAR, FAR)], alerts.schema).coalesce(1).write.mode("append").parquet(left)
    source.heartbeat(spark, FAR).coalesce(1).write.mode("append").parquet(right)
    streamed = se.stream_evidence(
        source.stream_packets(spark, left, alerts.schema, files_per_trigger=1), source.stream_packets(spark, right, files_per_trigger=1),
        longest_us=20 * S, pad_us=2 * S, delay_us=6 * S,
    )
    got = source.drain(streamed.select("alert_id", "seq").where("alert_id IS NOT NULL"), "evidence").collect()
    want = evidence.evidence(alerts, frame, 2 * S, 10 * S).select("alert_id", "seq").collect()
    assert len(want) > 30 and {r.alert_id for r in got if r.seq is None} >= {"bare"}
    assert sorted((r.alert_id, r.seq) for r in got if r.seq is not None) == sorted(map(tuple, want))


def test_feed_delivers_each_alert_once(spark):
    path = fresh_dir(spark, "feed")
    frame = spark.range(20).withColumn("ts_us", 100 - F.col("id"))
    sink = feed.feed_sink(path, ["ts_us"])
    sink(frame.where("id < 7"), 0)
    sink(frame.where("id < 7"), 0)  # delivered again after its commit
    frame.withColumn("feed_no", F.lit(1).cast("bigint")).write.parquet(f"{path}/alerts/batch_id=1")  # broken off before its commit
    assert feed.read_feed(spark, path, frame.schema).count() == 7
    sink(frame.where("id BETWEEN 7 AND 11"), 1)
    sink(frame.where("id < 0"), 2)
    sink(frame.where("id > 11"), 3)
    got = feed.read_feed(spark, path, frame.schema).orderBy("feed_no").collect()
    assert [r.feed_no for r in got] == list(range(1, 21))
    assert [r.id for r in got] == [*range(6, -1, -1), *range(11, 6, -1), *range(19, 11, -1)]


def test_without_heartbeat_open_flows_stay_open(spark, packets):
    frame = packets((10, {}), (11, {}), (100, dict(src_port=7)))
    path = fresh_dir(spark, "landed")
    _land(spark, frame, path, 1, "ts_us")
    got = source.drain(sf.stream_flows(source.stream_packets(spark, path), 5 * S, 60 * S), "flows").collect()
    assert [(r.src_port, r.fwd_packets) for r in got] == [(40000, 2)]


def test_windows_close_in_order(spark):
    rows = spark.createDataFrame([(44 * S, 1, 0), (46 * S, 1, 0), (52 * S, 1, 0)], "last_us bigint, fwd_packets bigint, bwd_packets bigint")
    path = fresh_dir(spark, "landed")
    _land(spark, rows, path, 3, "last_us")
    stream = source.stream_packets(spark, path, rows.schema, files_per_trigger=1)
    got = source.drain(sf.stream_windows(stream, 15 * S, 5 * S), "windows").collect()
    assert [(r.window, r.flows) for r in got] == [(2, 1)]


@pytest.mark.parametrize("parts", [1, 4])
def test_scan_and_block_streams_equal_batch(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), str(i), 1, rng.choice([0, 1, 2, 3, 4]), "tcp", (i + 1) * S) for i in range(60)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_us bigint")
    path = fresh_dir(spark, "landed")
    _land(spark, frame, path, parts, "start_us")
    stream = source.stream_packets(spark, path, frame.schema, files_per_trigger=1)
    got = {r.dst_ip: r.port_scan for r in source.drain(state.stream_port_scan(stream, 5 * S, 4), "scan").collect()}
    want = {r.dst_ip: r.port_scan for r in rules.port_scan(frame, 5 * S, 4).collect()}
    assert got == want

    hits = spark.createDataFrame([(rng.choice("ab"), i * 90 * S + 1, True) for i in range(20)] + [("a", 777 * S, False), ("", FAR, False)], "ip string, ts_us bigint, hit boolean")
    path = fresh_dir(spark, "landed")
    _land(spark, hits, path, parts, "ts_us")
    blocks = source.drain(state.stream_blocks(source.stream_packets(spark, path, hits.schema, files_per_trigger=1), 300 * S), "blocks")
    batch = respond.block_intervals(hits.where("hit"), hits.where("NOT hit AND ip <> ''"))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, batch.select(*blocks.columns).collect()))


def test_ledger_stream_and_replay(spark):
    frame = spark.range(30).select("id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"), (F.col("id") * S).alias("ts_us"))
    path, out = fresh_dir(spark, "landed"), fresh_dir(spark, "ledger")
    _land(spark, frame, path, 3, "id")
    stream = source.stream_packets(spark, path, frame.schema, files_per_trigger=1)
    sink = sl.ledger_sink(out, ["id"])
    source.deliver(stream, sink, f"{out}-progress").awaitTermination()
    before = sorted(map(tuple, sl.read_blocks(spark, out).collect()))
    assert [b[1] for b in before] == [0, 1, 2]
    sink(frame.where("id BETWEEN 20 AND 29"), 2)  # the last batch delivered again
    assert sorted(map(tuple, sl.read_blocks(spark, out).collect())) == before
    blocks = sl.read_blocks(spark, out)
    roots = evidence.merkle_root(sl.read_leaves(spark, out).join(blocks.select("batch_id", "block_index"), "batch_id"), ["block_index"])
    roots = roots.select("block_index", F.col("root").alias("_root"), F.col("leaves").alias("_leaves"))
    assert {r.reason for r in lg.verify_ledger(blocks.drop("batch_id"), roots).collect()} == {None}


def test_late_rows(spark, packets):
    on_time, late = source.split_late(packets((0, {}), (20, {}), (16, {}), (14, {}), (21, {})), 5 * S)
    assert [(r.seq, r.lateness_us) for r in late.collect()] == [(3, S)] and on_time.count() == 4
    assert PACKET.names == on_time.columns


def test_streamed_tables_may_be_folders(spark, tmp_path):
    from flowspark.plans import streams

    supplied = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{supplied}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (streams.stream_ledger, streams.stream_noise_filter):
        one, many = (sorted(map(tuple, query(spark, d).collect()), key=repr) for d in (supplied, str(tmp_path)))
        assert one and one == many
