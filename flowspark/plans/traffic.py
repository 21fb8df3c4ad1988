"""Packets, filters, flows and flow statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions.numeric import encode_ts, signed_expm1, signed_log1p
from flowspark.functions.packets import TCP_FLAGS, byte_entropy, entropy_class, port_profile, port_tier, service_name, tcp_flag
from flowspark.operators import filters, flows, rules
from flowspark.plans import threat
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS

NOISE_IPS = "('255.255.255.255','224.0.0.251','239.255.255.250')"
SERVICE_SQL = (
    "CASE {p} WHEN 21 THEN 'FTP' WHEN 22 THEN 'SSH' WHEN 23 THEN 'Telnet' WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS' "
    "WHEN 80 THEN 'HTTP' WHEN 110 THEN 'POP3' WHEN 143 THEN 'IMAP' WHEN 443 THEN 'HTTPS' WHEN 445 THEN 'SMB' "
    "WHEN 3389 THEN 'RDP' WHEN 3306 THEN 'MySQL' WHEN 5432 THEN 'PostgreSQL' WHEN 8080 THEN 'HTTP-Alt' "
    "WHEN 8443 THEN 'HTTPS-Alt' END"
)
TIER_SQL = (
    "CASE WHEN {p} BETWEEN 0 AND 1023 THEN 'SYSTEM_WELL_KNOWN' WHEN {p} BETWEEN 1024 AND 49151 "
    "THEN 'REGISTERED_SERVICE' ELSE 'DYNAMIC_EPHEMERAL' END"
)


def packet_view(spark, sf):
    return v.packets_v(spark, sf).withColumn("payload", F.col("payload").cast("string"))


def noise_filter(spark, sf):
    rows = v.packets_v(spark, sf).withColumn("reason", filters.noise_reason())
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes")
    )


def noise_filter_dns_kept(spark, sf):
    """DNS flag off: port 53 survives although the port list has it."""
    kept = filters.filter_noise(v.packets_v(spark, sf), filter_dns=False)
    return kept.groupBy("dst_port").agg(F.count(F.lit(1)).alias("packets"))


def whitelist_pairs(spark, sf):
    """Packets left after excluding the address pairs that ever used port 22."""
    packets = v.packets_v(spark, sf)
    pairs = packets.where("dst_port = 22").select(F.col("src_ip").alias("a_ip"), F.col("dst_ip").alias("b_ip"))
    kept = filters.exclude_pairs(packets, pairs)
    return kept.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("seq").alias("seq_sum"))


def background_pruner(spark, sf):
    kept = filters.prune_background(v.packets_v(spark, sf))
    return kept.groupBy("protocol", "dst_port").agg(F.count(F.lit(1)).alias("packets"))


def prune_statistics(spark, sf):
    return v.rounded(filters.prune_stats(v.packets_v(spark, sf)), ["prune_ratio"])


def chronology_check(spark, sf):
    return filters.check_chronology(v.packets_v(spark, sf), ["src_ip"])


def tcp_flag_counts(spark, sf):
    flags = F.col("tcp_flags")
    return v.packets_v(spark, sf).groupBy("protocol").agg(
        *[F.count_if(tcp_flag(flags, n)).alias(n.lower()) for n in TCP_FLAGS]
    )


def port_profiles(spark, sf):
    profile = port_profile(F.col("src_port"), F.col("dst_port"))
    return (
        v.packets_v(spark, sf)
        .groupBy("src_port", "dst_port")
        .agg(F.count(F.lit(1)).alias("packets"))
        .select("src_port", "dst_port", "packets", profile.alias("p"))
        .select("src_port", "dst_port", "packets", "p.*")
    )


def service_traffic(spark, sf):
    tier = port_tier(F.col("dst_port")).alias("dst_tier")
    return v.packets_v(spark, sf).groupBy(service_name(F.col("src_port"), F.col("dst_port")).alias("service"), tier).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes")
    )


def payload_entropy(spark, sf):
    """Byte entropy and class of every document's whole text."""
    docs = v.table(spark, sf, "documents").select("doc_id", byte_entropy(F.col("text").cast("binary")).alias("entropy"))
    return docs.select("doc_id", F.round("entropy", 6).alias("entropy"), entropy_class(F.col("entropy")).alias("entropy_class"))


def conversations_by_pair(spark, sf):
    keyed = flows.conversation_key(v.packets_v(spark, sf))
    grouped = keyed.groupBy(*flows.CONVERSATION).agg(
        F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    ends = F.array_sort(F.array(F.concat_ws(":", "lo_ip", "lo_port"), F.concat_ws(":", "hi_ip", "hi_port")))
    return grouped.select(F.array_join(ends, "|").alias("pair"), "protocol", "packets", "first_us", "last_us")


def idle_sessions(spark, sf):
    packets = v.packets_v(spark, sf)
    rows = flows.sessionize(packets, v.IDLE)
    sessions = rows.groupBy(*flows.CONVERSATION, "segment").agg(
        F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us")
    )
    ends = F.array_sort(F.array(F.concat_ws(":", "lo_ip", "lo_port"), F.concat_ws(":", "hi_ip", "hi_port")))
    return sessions.select(F.array_join(ends, "|").alias("pair"), "protocol", "segment", "packets", "start_us", "last_us")


def flow_assembly(spark, sf):
    """Every flow with its handshake counters."""
    assembled, _ = v.assembled_v(spark, sf)
    counters = ["last_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "syn_ack_count"]
    rows = flows.flow_table(assembled).select(
        *v.FLOW_IDENTITY, *counters, "ack_count", "rst_count", "fin_count", "syn_ack_ratio"
    )
    return v.rounded(rows, ["syn_ack_ratio"])


def flow_statistics(spark, sf):
    """The sixteen flow features, gaps of sorted times."""
    table = v.flows_v(spark, sf).select(*v.flow_columns())
    return v.rounded(table, [c for c in FEATURE_COLUMNS if not c.endswith(("_packets", "_bytes")) and c != "duration_us"])


def flow_statistics_arrival(spark, sf):
    """Service variant: arrival-order gaps, ratio 0 without forward packets."""
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    table = flows.flow_features(assembled, "arrival", largest=largest)
    names = ["iat_mean_us", "fwd_iat_mean_us", "bwd_iat_mean_us", "down_up_ratio"]
    return v.rounded(table.select(*v.FLOW_IDENTITY, *names), names)


def flow_handshake(spark, sf):
    assembled, _ = v.assembled_v(spark, sf, keep=True)
    rows = flows.handshake(assembled, flows.flow_table(assembled))
    return rows.select(*v.FLOW_IDENTITY, "syn_count", "syn_ack_count", "handshake_complete", "handshake_latency_us")


def flow_handshake_arrival(spark, sf):
    """Service variant: any forward packet with ACK completes, RST is reported."""
    assembled, _ = v.assembled_v(spark, sf, keep=True)
    rows = flows.handshake(assembled, flows.flow_table(assembled), "arrival")
    return rows.select(*v.FLOW_IDENTITY, "syn_count", "handshake_complete", (F.col("rst_count") > 0).alias("rst_seen"))


def inter_arrival(spark, sf):
    assembled, largest = v.assembled_v(spark, sf)
    rows = flows.gaps(assembled, ["ts_us", "seq"], largest=largest)
    return rows.select("seq", "forward", "gap_us", "side_gap_us")


def flow_payload_entropy(spark, sf):
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    entropy = flows.flow_entropy(assembled, largest=largest)
    table = flows.flow_table(assembled).join(entropy, flows.FLOW)
    return table.select(*v.FLOW_IDENTITY, "payload_bytes", "entropy_class", F.round("payload_entropy", 6).alias("entropy"))


def _vector(rows, column, size, coarse=()):
    """One column per number; means and deviations are rounded coarsely, as engines sum in other orders."""
    return rows.select(
        *v.FLOW_IDENTITY,
        *[F.round(F.get(F.col(column), F.lit(i)), 2 if i in coarse else 7).alias(f"v{i:02d}") for i in range(size)],
    )


def micro_vectors(spark, sf):
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    micro = flows.micro_vector(assembled, flows.flow_entropy(assembled, largest=largest))
    return _vector(flows.flow_table(assembled).join(micro, flows.FLOW), "micro", 16, (1, 3))


def macro_vectors(spark, sf):
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    table = flows.flow_table(assembled)
    macro = flows.macro_vector(assembled, table, largest=largest)
    return _vector(table.join(macro, flows.FLOW), "macro", 16, range(7, 13))


def edge_vectors(spark, sf):
    """Both halves together, as exported with the edges of a snapshot."""
    assembled, largest = v.assembled_v(spark, sf, keep=True)
    table = flows.flow_table(assembled)
    edges = flows.edge_vectors(assembled, table, flows.flow_entropy(assembled, largest=largest), largest)
    rows = table.join(edges, flows.FLOW)
    return rows.select(
        *v.FLOW_IDENTITY,
        F.size("edge_vector").alias("size"),
        F.round(F.get("edge_vector", F.lit(0)), 7).alias("ttl_mean"),
        F.round(F.get("edge_vector", F.lit(14)), 7).alias("syn_ratio"),
        F.get("edge_vector", F.lit(31)).alias("bytes"),
    )


def feature_transform(spark, sf):
    """Signed log features, the inverse, and both time encodings."""
    table = v.flows_v(spark, sf)
    x = F.col("bytes_per_s") - F.col("avg_packet_size")
    seconds = F.col("last_us") / 1e6
    return table.select(
        *v.FLOW_IDENTITY,
        F.round(signed_log1p(F.col("duration_us").cast("double")), 6).alias("log_duration"),
        F.round(signed_log1p(x), 6).alias("log_difference"),
        F.round(signed_expm1(signed_log1p(x)), 4).alias("difference"),
        encode_ts(seconds).alias("t_seconds"),
        encode_ts(seconds, "float32_legacy").alias("t_float32"),
    )


def flow_validation(spark, sf):
    """Request check over flows in start order per source; of eleven start times, four have each its damage."""
    table = v.flows_v(spark, sf)
    kind, features = F.col("start_us") % 11, F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS])
    odd = lambda x: F.concat(F.slice(features, 1, 15), F.array(F.lit(x).cast("double")))
    request = table.select(
        "src_ip",
        F.col("start_us").alias("seq"),
        F.when(kind == 5, F.lit(-1.0)).otherwise(F.col("start_us") / 1e6).alias("timestamp"),
        F.when(kind == 3, odd("NaN")).when(kind == 7, F.slice(features, 1, 15)).when(kind == 9, odd(1e300)).otherwise(features).alias("features"),
    )
    checked = filters.validate_flows(request, ["src_ip"])
    return checked.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("flows"))


def run_counters(spark, sf):
    """Packets, flows, threats by the rules, and flows that are not idle yet at the last packet."""
    packets = v.packets_v(spark, sf).agg(F.count(F.lit(1)).alias("packets"), F.max("ts_us").alias("_end"))
    table = rules.evaluate_rules(v.flows_v(spark, sf), v.SCAN_WINDOW, v.SCAN_PORTS).crossJoin(F.broadcast(packets))  # one row
    return table.groupBy("packets").agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("rst_count") > 0).alias("reset_flows"),
        F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"),
        F.count("rule_threat").alias("threats"),
        F.count_if(F.col("last_us") + v.IDLE > F.col("_end")).alias("active_flows"),
    )


def chronological_flows(spark, sf):
    return v.flows_v(spark, sf).select(*v.FLOW_IDENTITY, "last_us").orderBy("last_us", "start_us")


QUERIES = {
    f.__name__: f
    for f in (
        packet_view,
        noise_filter,
        noise_filter_dns_kept,
        whitelist_pairs,
        background_pruner,
        prune_statistics,
        chronology_check,
        tcp_flag_counts,
        port_profiles,
        service_traffic,
        payload_entropy,
        conversations_by_pair,
        idle_sessions,
        flow_assembly,
        flow_statistics,
        flow_statistics_arrival,
        flow_handshake,
        flow_handshake_arrival,
        inter_arrival,
        flow_payload_entropy,
        micro_vectors,
        macro_vectors,
        edge_vectors,
        feature_transform,
        flow_validation,
        run_counters,
        chronological_flows,
    )
}

_P = f"WITH {v.PACKETS}"
_F = v.FLOW_CTES
_ID = ", ".join(v.FLOW_IDENTITY)
_NOISE = f"""CASE WHEN src_ip IN {NOISE_IPS} OR dst_ip IN {NOISE_IPS} OR dst_ip LIKE '224.%' OR dst_ip LIKE '239.%' THEN 'broadcast'
  WHEN src_port IN (53, 5353) OR dst_port IN (53, 5353) THEN 'dns' WHEN src_port = 123 OR dst_port = 123 THEN 'ntp'
  WHEN src_port IN (67, 68, 1900, 137, 138) OR dst_port IN (67, 68, 1900, 137, 138) THEN 'port' ELSE 'kept' END"""
_BACKGROUND = """((protocol = 'udp' AND (src_port = 123 OR dst_port = 123)) OR protocol IN ('arp', 'rarp')
  OR (protocol = 'udp' AND (src_port = 53 OR dst_port = 53) AND length < 120) OR dst_port IN (5353, 1900, 5355, 137, 138))"""
_PAIR = """least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' ||
  greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port)"""
_INITIATED = f"""SELECT {_ID}, lo, hi, flow_no FROM flows_v"""
_BYTES = """
loaded AS (SELECT lo, hi, protocol, flow_no, ts_us, seq, hex(payload) AS h, length(hex(payload)) // 2 AS n,
    sum(length(hex(payload)) // 2) OVER (PARTITION BY lo, hi, protocol, flow_no ORDER BY ts_us, seq) AS through FROM flow_packets),
used AS (SELECT *, least(n, 4096 - (through - n)) AS take FROM loaded WHERE through - n < 4096),
byte_counts AS (SELECT lo, hi, protocol, flow_no, substr(h, 2 * i + 1, 2) AS b, count(*) AS c
  FROM (SELECT *, unnest(range(0, CAST(take AS BIGINT))) AS i FROM used) GROUP BY ALL),
flow_bytes AS (SELECT lo, hi, protocol, flow_no, CAST(sum(c) AS BIGINT) AS payload_bytes,
    log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM byte_counts GROUP BY ALL)"""
_ECLASS = """CASE WHEN entropy >= 7.2 THEN 'HIGH_ENCRYPTED_OR_PACKED' WHEN entropy >= 5.0 THEN 'MEDIUM_STRUCTURED'
  WHEN entropy > 1e-12 THEN 'LOW_TEXT_OR_SPARSE' ELSE 'EMPTY' END"""
_GAPS = """
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, flow_no ORDER BY ts_us, seq) AS gap_us,
  ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, flow_no, forward ORDER BY ts_us, seq) AS side_gap_us FROM flow_packets)"""
_TCP = "protocol = 'tcp' AND"


def _completed(ack: str) -> str:
    return f"""
opened AS (SELECT lo, hi, protocol, flow_no,
    min(seq) FILTER (forward AND {_TCP} (tcp_flags & 18) = 2) AS s1, min(seq) FILTER (NOT forward AND {_TCP} (tcp_flags & 18) = 18) AS s2,
    min(ts_us) FILTER (forward AND {_TCP} (tcp_flags & 18) = 2) AS syn_ts FROM flow_packets GROUP BY ALL),
completed AS (SELECT lo, hi, protocol, flow_no, min(ts_us) AS ack_ts FROM flow_packets JOIN opened USING (lo, hi, protocol, flow_no)
  WHERE forward AND {_TCP} {ack} AND seq > s1 AND seq > s2 GROUP BY ALL)"""


_MICRO = """
micro AS (SELECT lo, hi, protocol, flow_no, avg(ttl) AS v00, var_pop(ttl) AS v01, avg(tcp_window) AS v02, var_pop(tcp_window) AS v03,
  CAST(count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 2) <> 0) AS DOUBLE) AS v04,
  CAST(count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 16) <> 0) AS DOUBLE) AS v05,
  CAST(count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 4) <> 0) AS DOUBLE) AS v06,
  CAST(count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 1) <> 0) AS DOUBLE) AS v07,
  CAST(count(*) FILTER (protocol = 'tcp' AND (tcp_flags & 8) <> 0) AS DOUBLE) AS v08 FROM flow_packets GROUP BY ALL)"""
_TOTAL = "greatest(1, v04 + v05 + v06 + v07 + v08)"


def _std(gap: str, cond: str) -> str:
    return f"coalesce(avg({gap}) FILTER ({cond}) / 1e6, 0) AS {{m}}, coalesce(stddev_pop({gap}) FILTER ({cond}) / 1e6, 0) AS {{s}}"


_SPREAD = (
    "spread AS (SELECT lo, hi, protocol, flow_no, "
    + _std("gap_us", "true").format(m="v07", s="v08")
    + ", "
    + _std("side_gap_us", "forward").format(m="v09", s="v10")
    + ", "
    + _std("side_gap_us", "NOT forward").format(m="v11", s="v12")
    + " FROM gaps GROUP BY ALL)"
)
_ROUNDED = [c for c in FEATURE_COLUMNS if not c.endswith(("_packets", "_bytes")) and c != "duration_us"]
_LOG = "sign({x}) * ln(1 + abs({x}))"
_FEATURE_LIST = ", ".join(FEATURE_COLUMNS)

ORACLE = {
    "packet_view": f"{_P} SELECT * FROM packets_v",
    "noise_filter": f"""{_P} SELECT {_NOISE} AS reason, protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes
        FROM packets_v GROUP BY 1, 2""",
    "noise_filter_dns_kept": f"""{_P} SELECT dst_port, count(*) AS packets FROM packets_v
        WHERE src_port <> 123 AND dst_port <> 123 AND src_port NOT IN (67, 68, 1900, 137, 138)
          AND dst_port NOT IN (67, 68, 1900, 137, 138) AND NOT (src_ip IN {NOISE_IPS} OR dst_ip IN {NOISE_IPS})
          AND dst_ip NOT LIKE '224.%' AND dst_ip NOT LIKE '239.%' GROUP BY 1""",
    "whitelist_pairs": f"""{_P}, pairs AS (SELECT src_ip AS a, dst_ip AS b FROM packets_v WHERE dst_port = 22)
        SELECT protocol, count(*) AS packets, CAST(sum(seq) AS BIGINT) AS seq_sum FROM packets_v p
        WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE (a = src_ip AND b = dst_ip) OR (a = dst_ip AND b = src_ip)) GROUP BY 1""",
    "background_pruner": f"""{_P} SELECT protocol, dst_port, count(*) AS packets FROM packets_v
        WHERE NOT {_BACKGROUND} GROUP BY 1, 2""",
    "prune_statistics": f"""{_P} SELECT count(*) AS examined, count(*) FILTER ({_BACKGROUND}) AS pruned,
        count(*) FILTER (NOT {_BACKGROUND}) AS retained,
        round(count(*) FILTER ({_BACKGROUND}) / count(*), 6) AS prune_ratio FROM packets_v""",
    "chronology_check": f"""{_P} SELECT src_ip, count(*) AS packets, count(*) FILTER (ts_us < 0) AS bad_times,
        count(*) FILTER (ts_us < before) AS steps_back
        FROM (SELECT *, lag(ts_us) OVER (PARTITION BY src_ip ORDER BY seq) AS before FROM packets_v) GROUP BY 1""",
    "tcp_flag_counts": f"""{_P} SELECT protocol, count(*) FILTER ((tcp_flags & 1) <> 0) AS fin, count(*) FILTER ((tcp_flags & 2) <> 0) AS syn,
        count(*) FILTER ((tcp_flags & 4) <> 0) AS rst, count(*) FILTER ((tcp_flags & 8) <> 0) AS psh,
        count(*) FILTER ((tcp_flags & 16) <> 0) AS ack, count(*) FILTER ((tcp_flags & 32) <> 0) AS urg FROM packets_v GROUP BY 1""",
    "port_profiles": f"""{_P}, g AS (SELECT src_port, dst_port, count(*) AS packets FROM packets_v GROUP BY 1, 2),
        s AS (SELECT *, {TIER_SQL.format(p="src_port")} AS src_tier, {TIER_SQL.format(p="dst_port")} AS dst_tier,
          coalesce({SERVICE_SQL.format(p="dst_port")}, {SERVICE_SQL.format(p="src_port")}, 'UNKNOWN') AS service,
          ({SERVICE_SQL.format(p="dst_port")}) IS NOT NULL OR dst_port < src_port AS client_to_server FROM g)
        SELECT *, src_tier = 'DYNAMIC_EPHEMERAL' AND dst_tier = 'DYNAMIC_EPHEMERAL' AND service = 'UNKNOWN' AS suspicious_ephemeral FROM s""",
    "service_traffic": f"""{_P} SELECT coalesce({SERVICE_SQL.format(p="dst_port")}, {SERVICE_SQL.format(p="src_port")}, 'UNKNOWN') AS service,
        {TIER_SQL.format(p="dst_port")} AS dst_tier, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets_v GROUP BY 1, 2""",
    "payload_entropy": f"""WITH h AS (SELECT doc_id, hex(text) AS h FROM documents),
        b AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS b, count(*) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM h)
          GROUP BY 1, 2),
        e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM b GROUP BY 1)
        SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy, CASE WHEN entropy IS NULL THEN 'EMPTY' ELSE {_ECLASS} END AS entropy_class
        FROM documents LEFT JOIN e USING (doc_id)""",
    "conversations_by_pair": f"""{_P} SELECT {_PAIR} AS pair, protocol, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us
        FROM packets_v GROUP BY 1, 2""",
    "idle_sessions": f"""{_P}, b AS (SELECT {_PAIR} AS pair, protocol, ts_us, seq,
          CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {_PAIR}, protocol ORDER BY ts_us, seq) < {v.IDLE} THEN 0 ELSE 1 END AS brk
          FROM packets_v),
        s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY pair, protocol ORDER BY ts_us, seq) AS BIGINT) AS segment FROM b)
        SELECT pair, protocol, segment, count(*) AS packets, min(ts_us) AS start_us, max(ts_us) AS last_us FROM s GROUP BY 1, 2, 3""",
    "flow_assembly": f"""{_F} SELECT {_ID}, last_us, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, syn_count, syn_ack_count,
        ack_count, rst_count, fin_count, round(syn_ack_ratio, 6) AS syn_ack_ratio FROM flows_v""",
    "flow_statistics": f"""{_F} SELECT {_ID}, duration_us, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
        {", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)} FROM flows_v""",
    "flow_statistics_arrival": f"""{_F}, g AS (SELECT lo, hi, protocol, flow_no, forward,
          ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, flow_no ORDER BY seq) AS gap,
          ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, flow_no, forward ORDER BY seq) AS side_gap FROM flow_packets),
        m AS (SELECT lo, hi, protocol, flow_no, avg(gap) FILTER (gap >= 0) AS a, avg(side_gap) FILTER (forward AND side_gap >= 0) AS f,
          avg(side_gap) FILTER (NOT forward AND side_gap >= 0) AS b FROM g GROUP BY ALL)
        SELECT {_ID}, round(coalesce(a, 0), 6) AS iat_mean_us, round(coalesce(f, 0), 6) AS fwd_iat_mean_us,
          round(coalesce(b, 0), 6) AS bwd_iat_mean_us, round(CASE WHEN fwd_packets > 0 THEN bwd_packets / fwd_packets ELSE 0 END, 6) AS down_up_ratio
        FROM flows_v JOIN m USING (lo, hi, protocol, flow_no)""",
    "flow_handshake": f"""{_F}, {_completed("(tcp_flags & 18) = 16")} SELECT {_ID}, syn_count, syn_ack_count,
        ack_ts IS NOT NULL AS handshake_complete, CASE WHEN ack_ts IS NOT NULL THEN greatest(ack_ts - syn_ts, 0) END AS handshake_latency_us
        FROM flows_v JOIN opened USING (lo, hi, protocol, flow_no) LEFT JOIN completed USING (lo, hi, protocol, flow_no)""",
    "flow_handshake_arrival": f"""{_F}, {_completed("(tcp_flags & 16) <> 0")} SELECT {_ID}, syn_count,
        ack_ts IS NOT NULL AS handshake_complete, rst_count > 0 AS rst_seen
        FROM flows_v LEFT JOIN completed USING (lo, hi, protocol, flow_no)""",
    "inter_arrival": f"{_F}, {_GAPS} SELECT seq, forward, gap_us, side_gap_us FROM gaps",
    "flow_payload_entropy": f"""{_F}, {_BYTES} SELECT {_ID}, coalesce(payload_bytes, 0) AS payload_bytes,
        CASE WHEN entropy IS NULL THEN 'EMPTY' ELSE {_ECLASS} END AS entropy_class, round(coalesce(entropy, 0), 6) AS entropy
        FROM flows_v LEFT JOIN flow_bytes USING (lo, hi, protocol, flow_no)""",
    "micro_vectors": f"""{_F}, {_BYTES}, {_MICRO} SELECT {_ID}, {", ".join(f"round(v{i:02d}, {2 if i in (1, 3) else 7}) AS v{i:02d}" for i in range(9))},
        {", ".join(f"round(v{i - 5:02d} / {_TOTAL}, 7) AS v{i:02d}" for i in range(9, 14))},
        round(v04 / (v05 + 1), 7) AS v14, round(coalesce(entropy, 0), 7) AS v15
        FROM flows_v JOIN micro USING (lo, hi, protocol, flow_no) LEFT JOIN flow_bytes USING (lo, hi, protocol, flow_no)""",
    "macro_vectors": f"""{_F}, {_GAPS}, {_SPREAD}, d AS (SELECT *, greatest(duration_us / 1e6, 1e-6) AS dur FROM flows_v)
        SELECT {_ID}, round(dur, 7) AS v00, CAST(fwd_packets AS DOUBLE) AS v01, CAST(bwd_packets AS DOUBLE) AS v02,
          round(fwd_len_mean, 7) AS v03, round(bwd_len_mean, 7) AS v04, round((fwd_bytes + bwd_bytes) / dur, 7) AS v05,
          round((fwd_packets + bwd_packets) / dur, 7) AS v06, {", ".join(f"round(v{i:02d}, 2) AS v{i:02d}" for i in range(7, 13))},
          round(down_up_ratio, 7) AS v13, round(avg_packet_size, 7) AS v14, CAST(fwd_bytes + bwd_bytes AS DOUBLE) AS v15
        FROM d JOIN spread USING (lo, hi, protocol, flow_no)""",
    "edge_vectors": f"""{_F}, {_MICRO} SELECT {_ID}, CAST(32 AS INT) AS size, round(v00, 7) AS ttl_mean, round(v04 / (v05 + 1), 7) AS syn_ratio,
        CAST(fwd_bytes + bwd_bytes AS DOUBLE) AS bytes FROM flows_v JOIN micro USING (lo, hi, protocol, flow_no)""",
    "feature_transform": f"""{_F}, x AS (SELECT *, bytes_per_s - avg_packet_size AS x FROM flows_v)
        SELECT {_ID}, round(ln(1 + duration_us), 6) AS log_duration, round({_LOG.format(x="x")}, 6) AS log_difference,
          round(x, 4) AS difference, CAST(trunc(last_us / 1e6) AS BIGINT) AS t_seconds,
          CAST(trunc(CAST(last_us / 1e6 AS FLOAT)) AS BIGINT) AS t_float32 FROM x""",
    "flow_validation": f"""{_F} SELECT CASE start_us % 11 WHEN 7 THEN 'feature_count' WHEN 3 THEN 'nonfinite_feature' WHEN 5 THEN 'timestamp_range' WHEN 9 THEN 'feature_range' ELSE 'ok' END AS outcome,
        count(*) AS flows FROM flows_v GROUP BY 1""",
    "run_counters": f"""{_F}, {threat.RULED_CTE} SELECT (SELECT count(*) FROM packets_v) AS packets, count(*) AS flows,
        count(*) FILTER (rst_count > 0) AS reset_flows, CAST(sum(fwd_bytes + bwd_bytes) AS BIGINT) AS bytes, count(rule_threat) AS threats,
        count(*) FILTER (last_us + {v.IDLE} > (SELECT max(ts_us) FROM packets_v)) AS active_flows FROM ruled""",
    "chronological_flows": f"{_F} SELECT {_ID}, last_us FROM flows_v ORDER BY last_us, start_us",
}
