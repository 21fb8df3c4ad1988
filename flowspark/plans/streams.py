"""Streaming forms of the batch queries, drained over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowspark.operators import evidence, filters, rules
from flowspark.operators import ledger as lg
from flowspark.plans import records, threat, traffic
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS
from flowspark.session import fresh_dir
from flowspark.streaming import evidence as se
from flowspark.streaming import feed
from flowspark.streaming import flows as sf_
from flowspark.streaming import ledger as sl
from flowspark.streaming import source, state

FAR_FUTURE = 4_102_444_800_000_000
#: How late packets may be, and the micro-batches they come in.
DELAY, LANDINGS = 6 * v.HOUR, 4


def _table_stream(spark, sf, name):
    """A supplied table as a stream, be it one file or a folder of files.

    The braces name just this path; without a pattern, a stream takes its path for a folder.
    """
    return source.stream_packets(spark, f"{sf}/{{{name}.parquet}}", v.table(spark, sf, name).schema)


def _landed(spark, frame, name):
    """Rows written once as a landing folder of the stream under test."""
    path = fresh_dir(spark, name)
    frame.write.parquet(path)
    return path


def _disordered(spark, frame, name, time, delay_us, end=None, landings=LANDINGS):
    """The frame as a stream of ``landings`` micro-batches: a row lands up to ``delay_us`` late, by its
    hash, so that files and the rows in them are out of order.  ``end`` is landed behind them."""
    path = fresh_dir(spark, name)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.withColumn("_at", F.col(time) + F.pmod(F.xxhash64(time), F.lit(delay_us)))
    first, last = rows.agg(F.min("_at"), F.max("_at")).first()
    turn = F.floor((F.col("_at") - first) * landings / (last - first + 1))
    for k in range(landings):
        rows.where(turn == k).drop("_at").repartition(files).write.mode("append").parquet(path)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(path)
    return source.stream_packets(spark, path, frame.schema, files_per_trigger=files)


def _packet_stream(spark, sf, closed=True):
    """Packets out of order within DELAY in four micro-batches; ``closed`` adds the heartbeat that ends all flows."""
    packets = v.packets_v(spark, sf)
    return _disordered(spark, packets, "packets", "ts_us", DELAY, source.heartbeat(spark, FAR_FUTURE, packets.schema) if closed else None)


def _flow_stream(spark, sf, closed=True):
    return sf_.stream_flows(_packet_stream(spark, sf, closed), v.IDLE, v.ACTIVE, DELAY)


def stream_noise_filter(spark, sf):
    """Streaming scan, packet view and filter; the kept packets land in a table."""
    packets = v.packets_of(_table_stream(spark, sf, "events"))
    kept = source.drain(filters.prune_background(packets).select("seq", "protocol", "dst_port"), "kept")
    return kept.groupBy("protocol", "dst_port").agg(F.count(F.lit(1)).alias("packets"))


def stream_flow_assembly(spark, sf):
    rows = source.drain(_flow_stream(spark, sf), "flows")
    counters = ["last_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "syn_ack_count"]
    return rows.select(*v.FLOW_IDENTITY, *counters, "ack_count", "rst_count", "fin_count", F.round("syn_ack_ratio", 6).alias("syn_ack_ratio"))


def stream_flow_statistics(spark, sf):
    """The sixteen features of streamed flows."""
    rows = source.drain(_flow_stream(spark, sf).select(*v.flow_columns()), "flows")
    return v.rounded(rows, [c for c in FEATURE_COLUMNS if not c.endswith(("_packets", "_bytes")) and c != "duration_us"])


def stream_flow_handshake(spark, sf):
    columns = ["syn_count", "syn_ack_count", "handshake_complete", "handshake_latency_us"]
    return source.drain(_flow_stream(spark, sf).select(*v.FLOW_IDENTITY, *columns), "flows")


def stream_flow_windows(spark, sf):
    """Windows behind the assembly, from packets: those that the watermark has closed at the end of the input."""
    return source.drain(sf_.stream_flow_windows(_flow_stream(spark, sf, closed=False), v.WINDOW, v.IDLE), "windows")


def _ruled(spark, sf):
    return state.stream_rules(_flow_stream(spark, sf), v.SCAN_WINDOW, v.SCAN_PORTS, v.ACTIVE)


def stream_rule_verdicts(spark, sf):
    """Every rule's verdict on every flow, from packets."""
    rows = source.drain(_ruled(spark, sf), "verdicts")
    return rows.select(*v.FLOW_IDENTITY, "rule_threat", F.round("rule_confidence", 6).alias("rule_confidence"), "rule_reason")


def stream_alert_feed(spark, sf):
    """Fused alerts from packets, numbered in the order of their flows' starts, each delivered once."""
    fused = rules.fuse(v.model_scored(_ruled(spark, sf))).where("is_attack")
    alerts = fused.select(*v.FLOW_IDENTITY, "threat_type", "detection_source", F.round("final_score", 6).alias("final_score"))
    path = fresh_dir(spark, "feed")
    order = ["start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    source.deliver(alerts, feed.feed_sink(path, order), f"{path}-progress").awaitTermination()
    return feed.read_feed(spark, path, alerts.schema)


def stream_evidence(spark, sf):
    """Evidence of streamed alerts from streamed packets, counted per alert."""
    alerts = records._alerts(spark, sf).select("alert_id", *records.HOSTS, "start_us", "alert_us")
    nullable = StructType([StructField(f.name, f.dataType) for f in alerts.schema])
    end = spark.createDataFrame([(None, "", "", 0, 0, "", FAR_FUTURE, FAR_FUTURE)], nullable)
    wanted = _disordered(spark, alerts, "alerts", "alert_us", DELAY, end)
    rows = se.stream_evidence(wanted, _packet_stream(spark, sf), longest_us=v.ACTIVE, pad_us=records.PAD, delay_us=DELAY)
    found = source.drain(rows.select("alert_id", "seq", "ts_us").where("alert_id IS NOT NULL"), "evidence")
    return found.groupBy("alert_id").agg(
        F.count("seq").alias("packets"), F.sum("seq").alias("seqs"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def stream_window_counts(spark, sf):
    """Windows of completed flows that the watermark has closed: all but the last."""
    flows = v.flows_v(spark, sf).select("last_us", "start_us", "src_ip", "fwd_packets", "bwd_packets")
    path = _landed(spark, flows, "flow-table")
    stream = source.stream_packets(spark, path, flows.schema)
    return source.drain(sf_.stream_windows(stream, v.WINDOW, 0), "windows")


def stream_port_scan(spark, sf):
    """Over a stream of finished flows that start out of order within DELAY."""
    flows = v.flows_v(spark, sf).select(*v.FLOW_IDENTITY, "last_us")
    end = spark.createDataFrame([("", "", 0, 0, source.HEARTBEAT, FAR_FUTURE, FAR_FUTURE)], flows.schema)
    stream = _disordered(spark, flows, "flow-table", "start_us", DELAY, end)
    return source.drain(state.stream_port_scan(stream, v.SCAN_WINDOW, v.SCAN_PORTS, DELAY), "scans")


def stream_block_register(spark, sf):
    flows = v.flows_v(spark, sf)
    hits = threat._hits(spark, sf, flows).withColumn("hit", F.lit(True))
    lifts = threat._unblocks(flows).withColumn("hit", F.lit(False))
    end = spark.createDataFrame([("", FAR_FUTURE, False)], hits.schema)
    path = _landed(spark, hits.unionByName(lifts).unionByName(end), "block-events")
    stream = source.stream_packets(spark, path, hits.schema)
    return source.drain(state.stream_blocks(stream, threat.TTL), "blocks")


def stream_ledger(spark, sf):
    """Document digests committed by a stream, then verified block by block."""
    docs = _table_stream(spark, sf, "documents")
    leaves = docs.select("doc_id", F.sha2("text", 256).alias("leaf"), (F.col("n_chars") * 1000000).alias("ts_us"))
    path = fresh_dir(spark, "ledger")
    source.deliver(leaves, sl.ledger_sink(path, ["doc_id"]), f"{path}-progress").awaitTermination()
    blocks = sl.read_blocks(spark, path)
    index = blocks.select("batch_id", "block_index")
    roots = evidence.merkle_root(sl.read_leaves(spark, path).join(index, "batch_id"), ["block_index"])
    roots = roots.select("block_index", F.col("root").alias("_root"), F.col("leaves").alias("_leaves"))
    checked = lg.verify_ledger(blocks.drop("batch_id"), roots)
    return checked.select("block_index", "leaf_count", "reason")


def late_packets(spark, sf):
    """Packets behind a six-hour watermark when events arrive by type in turn."""
    packets = v.packets_v(spark, sf)
    shuffled = packets.withColumn("seq", F.col("seq") + F.when(F.col("seq") % 5 == 0, 200).otherwise(0))
    shuffled = shuffled.withColumn("seq", F.col("seq") * 2 + F.when(F.col("seq") % 5 == 0, 1).otherwise(0))
    unique = shuffled.groupBy("seq").agg(F.max("ts_us").alias("ts_us"))
    on_time, late = source.split_late(unique, 6 * v.HOUR)
    counted = on_time.agg(F.lit("on_time").alias("kind"), F.count(F.lit(1)).alias("packets"), F.lit(None).cast("bigint").alias("worst_us"))
    return counted.unionByName(late.agg(F.lit("late").alias("kind"), F.count(F.lit(1)).alias("packets"), F.max("lateness_us").alias("worst_us")))


QUERIES = {
    f.__name__: f
    for f in (
        stream_noise_filter,
        stream_flow_assembly,
        stream_flow_statistics,
        stream_flow_handshake,
        stream_flow_windows,
        stream_rule_verdicts,
        stream_alert_feed,
        stream_evidence,
        stream_window_counts,
        stream_port_scan,
        stream_block_register,
        stream_ledger,
        late_packets,
    )
}

_F = v.FLOW_CTES
ORACLE = {
    "stream_noise_filter": traffic.ORACLE["background_pruner"],
    "stream_flow_assembly": traffic.ORACLE["flow_assembly"],
    "stream_flow_statistics": traffic.ORACLE["flow_statistics"],
    "stream_flow_handshake": traffic.ORACLE["flow_handshake"],
    "stream_flow_windows": f"""{_F} SELECT last_us // {v.WINDOW} AS "window", count(*) AS flows,
          CAST(sum(fwd_packets + bwd_packets) AS BIGINT) AS packets, max(last_us) AS latest_us FROM flows_v GROUP BY 1
        HAVING (last_us // {v.WINDOW} + 1) * {v.WINDOW} + {v.IDLE} <= (SELECT max(ts_us) - {DELAY} FROM packets_v)""",
    "stream_rule_verdicts": threat.ORACLE["rule_engine"],
    "stream_alert_feed": f"""{_F}, {threat.FUSED_CTE}, {threat._NUMBERED} SELECT incident_no AS feed_no, {", ".join(v.FLOW_IDENTITY)},
          threat_type, detection_source, round(final_score, 6) AS final_score FROM named""",
    "stream_evidence": records.ORACLE["evidence_packets"],
    "stream_window_counts": f"""{_F}, w AS (SELECT last_us // {v.WINDOW} AS "window", count(*) AS flows,
          CAST(sum(fwd_packets + bwd_packets) AS BIGINT) AS packets, max(last_us) AS latest_us FROM flows_v GROUP BY 1)
        SELECT * FROM w WHERE "window" < (SELECT max("window") FROM w)""",
    "stream_port_scan": threat.ORACLE["port_scan_rule"],
    "stream_block_register": threat.ORACLE["block_register"],
    "stream_ledger": "SELECT CAST(0 AS BIGINT) AS block_index, count(*) AS leaf_count, CAST(NULL AS VARCHAR) AS reason FROM documents",
    "late_packets": f"""WITH {v.PACKETS}, s AS (SELECT seq + CASE WHEN seq % 5 = 0 THEN 200 ELSE 0 END AS s1, ts_us FROM packets_v),
        u AS (SELECT s1 * 2 + CASE WHEN s1 % 5 = 0 THEN 1 ELSE 0 END AS seq, max(ts_us) AS ts_us FROM s GROUP BY 1),
        r AS (SELECT *, max(ts_us) OVER (ORDER BY seq) - {6 * v.HOUR} - ts_us AS behind FROM u)
        SELECT 'on_time' AS kind, count(*) AS packets, CAST(NULL AS BIGINT) AS worst_us FROM r WHERE behind <= 0
        UNION ALL SELECT 'late', count(*), max(behind) FROM r WHERE behind > 0""",
}
