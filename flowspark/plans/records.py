"""Evidence joins, state hashes, Merkle trees and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import evidence as ev
from flowspark.operators import ledger as lg
from flowspark.operators import respond as rs
from flowspark.plans import threat
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS
from flowspark.sources import artifacts

PAD, BUCKET = v.HOUR, 6 * v.HOUR
HOSTS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _alerts(spark, sf):
    """Flows the rules or the model flagged, with a readable id."""
    fused = threat._fused(spark, sf).where("is_attack")
    return fused.select(
        F.concat_ws("|", *v.FLOW_IDENTITY).alias("alert_id"), *HOSTS, "start_us", F.col("last_us").alias("alert_us"),
        *FEATURE_COLUMNS, "final_score", "model_p", "model_stage", "stage_name", "syn_ack_ratio", "threat_type",
    )


def evidence_packets(spark, sf):
    rows = ev.evidence(_alerts(spark, sf), v.packets_v(spark, sf), PAD, BUCKET)
    return rows.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("seq").alias("seqs"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def evidence_between_hosts(spark, sf):
    """Without ports and protocol: everything between the two addresses."""
    rows = ev.evidence(_alerts(spark, sf), v.packets_v(spark, sf), PAD, BUCKET, ports=False)
    return rows.groupBy("alert_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("seq").alias("seqs"))


def _digests(spark, sf):
    rows = ev.evidence(_alerts(spark, sf), v.packets_v(spark, sf), PAD, BUCKET)
    return ev.evidence_digest(rows, F.col("payload"))


def evidence_digests(spark, sf):
    return _digests(spark, sf)


def _hashes(alerts):
    c = F.col
    digest = ev.state_hash(
        {
            "alert_id": c("alert_id"), "timestamp": c("alert_us"), "src_ip": c("src_ip"), "dst_ip": c("dst_ip"),
            "src_port": c("src_port"), "dst_port": c("dst_port"), "protocol": c("protocol"),
            "attack_probability": c("final_score"), "conformal_p_value": 1 - c("model_p"), "payload_entropy": F.lit(0.0),
            "syn_ack_ratio": c("syn_ack_ratio"), "conformal_confirmed": c("model_p") >= 0.9, "mitre_stage": c("model_stage"),
            "stage_name": c("stage_name"), "pcap_hash": F.sha2("alert_id", 256),
            "features": F.array(*[c(f).cast("double") for f in FEATURE_COLUMNS]),
        }
    )
    return alerts.select("alert_id", digest.alias("state_hash"))


def alert_state_hashes(spark, sf):
    return _hashes(_alerts(spark, sf))


def merkle_roots(spark, sf):
    return ev.merkle_root(v.leaves_v(spark, sf), ["batch"])


def merkle_root_of_all(spark, sf):
    """One tree over every document."""
    leaves = v.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("leaf"))
    return ev.merkle_root(leaves, [])


def merkle_proofs(spark, sf):
    proofs = ev.merkle_proof(v.leaves_v(spark, sf), ["batch"])
    roots = ev.merkle_root(v.leaves_v(spark, sf), ["batch"]).select("batch", "root")
    text = F.array_join(F.transform("proof", lambda s: F.concat_ws(":", s["side"], s["sibling"])), ",")
    checked = proofs.join(roots, "batch")
    return checked.select("batch", "pos", text.alias("proof"), ev.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")).alias("verifies"))


def _headers(spark, sf):
    roots = ev.merkle_root(v.leaves_v(spark, sf), ["batch"])
    stamp = F.concat((F.lit(1704067200) + F.col("batch") * 15).cast("string"), F.lit(".5"))
    return roots.select(F.col("batch").alias("position"), F.col("leaves").alias("leaf_count"), F.col("root").alias("merkle_root"), stamp.alias("timestamp"))


def _ledger(spark, sf):
    """A chained ledger over the leaf batches, one block per batch."""
    headers = _headers(spark, sf)
    return headers.join(lg.relink(headers), "position")


def ledger_chain(spark, sf):
    return _ledger(spark, sf).select("block_index", "prev_block_hash", "block_hash")


def _roots(spark, sf):
    return ev.merkle_root(v.leaves_v(spark, sf), ["batch"]).select(
        F.col("batch").alias("block_index"), F.col("root").alias("_root"), F.col("leaves").alias("_leaves")
    )


def ledger_verification(spark, sf):
    """A sound ledger, then one damaged in four ways; the first failed check is named."""
    ledger = _ledger(spark, sf).drop("position")
    damaged = ledger.withColumns(
        {
            "leaf_count": F.when(F.col("block_index") % 10 == 3, F.col("leaf_count") + 1).otherwise(F.col("leaf_count")),
            "timestamp": F.when(F.col("block_index") % 10 == 5, F.concat("timestamp", F.lit("1"))).otherwise(F.col("timestamp")),
            "prev_block_hash": F.when(F.col("block_index") % 10 == 7, F.sha2("block_hash", 256)).otherwise(F.col("prev_block_hash")),
        }
    )
    roots = _roots(spark, sf)
    sound = lg.verify_ledger(ledger, roots).select(F.lit("sound").alias("ledger"), "block_index", "reason")
    bad = lg.verify_ledger(damaged, roots).select(F.lit("damaged").alias("ledger"), "block_index", "reason")
    return sound.unionByName(bad)


def _forked(spark, sf):
    """Documents as blocks of a forked ledger: every fifth block hangs two back."""
    docs = v.table(spark, sf, "documents").select("doc_id")
    back = F.when(F.col("doc_id") % 5 == 4, 2).otherwise(1)
    parent = F.col("doc_id") - back
    return docs.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("block_hash"),
        F.when(parent < 0, F.lit(lg.GENESIS)).otherwise(F.sha2(parent.cast("string"), 256)).alias("prev_block_hash"),
        F.when(F.col("doc_id") < 4, F.col("doc_id")).otherwise(F.col("doc_id") - F.floor((F.col("doc_id") + 1) / 5)).alias("block_index"),
    )


def ledger_tips(spark, sf):
    return lg.ledger_tips(_forked(spark, sf)).select("block_hash", "block_index")


def ledger_branches(spark, sf):
    return lg.ledger_branches(_forked(spark, sf))


def incident_reports(spark, sf):
    """Alerts with stage set, planned actions and evidence digest."""
    alerts = _alerts(spark, sf)
    sets = alerts.select("alert_id", F.array("stage_name").alias("stage_set"))
    gated = alerts.join(sets, "alert_id").withColumns(
        {"attack_p": F.col("final_score"), "confirmed": F.lit(True), "stage_validated": F.lit(True), "calibrated": F.lit(True)}
    )
    planned = rs.plan_actions(gated).select("alert_id", "action_type")
    digests = _digests(spark, sf).select("alert_id", F.col("packets").alias("evidence_packets"))
    report = rs.incident_report(alerts.select("alert_id", "threat_type", "start_us"), sets, planned, digests)
    return report.select(
        "alert_id", "threat_type", F.array_join("stage_set", ",").alias("stages"), F.array_join("actions", ",").alias("actions"), "evidence_packets"
    )


def recorded_digests(spark, sf):
    """Recorded digests against recomputed ones: changed, missing and extra artifacts."""
    docs = v.table(spark, sf, "documents")
    stored = F.when(F.col("doc_id") % 9 == 4, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    recorded = docs.where(F.col("lang") != "de").select(F.col("doc_id").cast("string").alias("artifact"), stored.alias("digest"))
    actual = docs.where(F.col("source") != "src0").select(F.col("doc_id").cast("string").alias("artifact"), F.sha2("text", 256).alias("digest"))
    return artifacts.verify_digests(recorded, actual)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_packets,
        evidence_between_hosts,
        evidence_digests,
        alert_state_hashes,
        merkle_roots,
        merkle_root_of_all,
        merkle_proofs,
        ledger_chain,
        ledger_verification,
        ledger_tips,
        ledger_branches,
        incident_reports,
        recorded_digests,
    )
}

_A = f"""{v.FLOW_CTES}, {threat.FUSED_CTE}, alerts AS (SELECT concat_ws('|', {", ".join(v.FLOW_IDENTITY)}) AS alert_id, *, last_us AS alert_us
  FROM fused WHERE is_attack)"""
_MATCH = f"p.ts_us >= a.start_us - {PAD} AND p.ts_us <= a.alert_us + {PAD}"
_EVIDENCE = f"""ev AS (SELECT a.alert_id, p.* FROM alerts a JOIN packets_v p ON p.protocol = a.protocol AND {_MATCH}
  AND ((p.src_ip = a.src_ip AND p.dst_ip = a.dst_ip AND p.src_port = a.src_port AND p.dst_port = a.dst_port)
    OR (p.src_ip = a.dst_ip AND p.dst_ip = a.src_ip AND p.src_port = a.dst_port AND p.dst_port = a.src_port)))"""


def _merkle(source: str, key: str, levels: int) -> str:
    """Unrolled levels; a finished tree passes its root on."""
    text = f"m0 AS (SELECT {key}, pos, leaf AS h FROM {source})"
    for i in range(levels):
        text += f""", c{i} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM m{i}),
m{i + 1} AS (SELECT {key}, pos // 2 AS pos, CASE WHEN max(size) = 1 THEN min(h) ELSE
  sha256(arg_min(h, pos) || arg_max(h, pos)) END AS h FROM c{i} GROUP BY {key}, pos // 2)"""
    return text


_LEVELS = 4
_ROOTS = f"""{v.LEAVES}, {_merkle("leaves_v", "batch", _LEVELS)}, sizes AS (SELECT batch, count(*) AS leaves FROM leaves_v GROUP BY 1),
roots AS (SELECT batch, h AS root, leaves FROM m{_LEVELS} JOIN sizes USING (batch))"""


def _header(prev: str, batch: str = "batch") -> str:
    return (
        f"""'{{"block_index":' || {batch} || ',"leaf_count":' || leaves || ',"merkle_root":"' || root """
        f"""|| '","prev_block_hash":"' || {prev} || '","timestamp":' || stamp || '}}'"""
    )


_ZEROS = "repeat('0', 64)"
_CHAIN = f"""{_ROOTS}, heads AS (SELECT batch, leaves, root, (1704067200 + batch * 15) || '.5' AS stamp FROM roots),
chain AS (SELECT batch, repeat('0', 64) AS prev_block_hash, sha256({_header(_ZEROS)}) AS block_hash FROM heads WHERE batch = 0
  UNION ALL SELECT h.batch, c.block_hash, sha256({_header("c.block_hash", "h.batch")})
  FROM chain c JOIN heads h ON h.batch = c.batch + 1)"""


def _proof() -> str:
    steps, joins = [], []
    for i in range(_LEVELS):
        at = f"(l.pos >> {i})"
        joins.append(f"LEFT JOIN m{i} o{i} ON o{i}.batch = l.batch AND o{i}.pos = xor({at}, 1) LEFT JOIN m{i} s{i} ON s{i}.batch = l.batch AND s{i}.pos = {at}")
        steps.append(
            f"CASE WHEN (SELECT count(*) FROM m{i} z WHERE z.batch = l.batch) > 1 THEN CASE WHEN {at} % 2 = 1 THEN 'left:' ELSE 'right:' END || coalesce(o{i}.h, s{i}.h) END"
        )
    return f"SELECT l.batch, l.pos, concat_ws(',', {', '.join(steps)}) AS proof, true AS verifies FROM leaves_v l {' '.join(joins)}"


_FIX6 = "CAST(CAST(round({x}, 6) AS DECIMAL(38, 6)) AS VARCHAR)"
# Hexadecimal floats as the JVM writes them: a fraction always, no plus before the exponent.
_HEX = "regexp_replace(replace(format('{{:a}}', CAST({x} AS DOUBLE)), 'p+', 'p'), '^(-?0x[0-9a-f])p', '\\1.0p')"
_FEATS = " || '\",\"' || ".join(_HEX.format(x=c) for c in FEATURE_COLUMNS)
_STATE = f"""'{{"alert_id":"' || alert_id || '","attack_probability":"' || {_FIX6.format(x="final_score")} || '","conformal_confirmed":' ||
  CASE WHEN model_p >= 0.9 THEN 'true' ELSE 'false' END || ',"conformal_p_value":"' || {_FIX6.format(x="1 - model_p")} || '","dst_ip":"' || dst_ip ||
  '","dst_port":' || dst_port || ',"features":["' || {_FEATS} || '"],"mitre_stage":' || model_stage || ',"payload_entropy":"0.000000","pcap_hash":"' ||
  sha256(alert_id) || '","protocol":"' || protocol || '","src_ip":"' || src_ip || '","src_port":' || src_port || ',"stage_name":"' || stage_name ||
  '","syn_ack_ratio":"' || {_FIX6.format(x="syn_ack_ratio")} || '","timestamp":' || alert_us || '}}'"""
_FORK = f"""forked AS (SELECT doc_id, doc_id - CASE WHEN doc_id % 5 = 4 THEN 2 ELSE 1 END AS parent,
  CASE WHEN doc_id < 4 THEN doc_id ELSE doc_id - (doc_id + 1) // 5 END AS block_index FROM documents)"""
ORACLE = {
    "evidence_packets": f"""{_A}, {_EVIDENCE} SELECT alert_id, count(*) AS packets, CAST(sum(seq) AS BIGINT) AS seqs, min(ts_us) AS first_us, max(ts_us) AS last_us
        FROM ev GROUP BY 1""",
    "evidence_between_hosts": f"""{_A} SELECT alert_id, count(*) AS packets, CAST(sum(seq) AS BIGINT) AS seqs FROM alerts a JOIN packets_v p
        ON {_MATCH} AND least(p.src_ip, p.dst_ip) = least(a.src_ip, a.dst_ip) AND greatest(p.src_ip, p.dst_ip) = greatest(a.src_ip, a.dst_ip) GROUP BY 1""",
    "evidence_digests": f"""{_A}, {_EVIDENCE}, lv AS (SELECT alert_id, row_number() OVER (PARTITION BY alert_id ORDER BY ts_us, seq) - 1 AS pos, sha256(payload) AS leaf FROM ev),
        {_merkle("lv", "alert_id", 7)}, n AS (SELECT alert_id, count(*) AS packets FROM lv GROUP BY 1)
        SELECT alert_id, h AS evidence_sha256, packets FROM m7 JOIN n USING (alert_id)""",
    "alert_state_hashes": f"{_A} SELECT alert_id, sha256({_STATE}) AS state_hash FROM alerts",
    "merkle_roots": f"WITH RECURSIVE {_ROOTS} SELECT * FROM roots",
    "merkle_root_of_all": f"""WITH lv AS (SELECT 0 AS k, doc_id AS pos, sha256(text) AS leaf FROM documents), {_merkle("lv", "k", 17)}
        SELECT h AS root, (SELECT count(*) FROM documents) AS leaves FROM m17""",
    "merkle_proofs": f"WITH RECURSIVE {_ROOTS} {_proof()}",
    "ledger_chain": f"WITH RECURSIVE {_CHAIN} SELECT batch AS block_index, prev_block_hash, block_hash FROM chain",
    "ledger_verification": """SELECT 'sound' AS ledger, b AS block_index, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT doc_id // 16 AS b FROM documents) x
        UNION ALL SELECT 'damaged', b, CASE b % 10 WHEN 3 THEN 'leaf_count' WHEN 5 THEN 'block_hash' WHEN 7 THEN 'block_hash' END
        FROM (SELECT DISTINCT doc_id // 16 AS b FROM documents) y""",
    "ledger_tips": f"""WITH {_FORK} SELECT sha256(CAST(doc_id AS VARCHAR)) AS block_hash, block_index FROM forked f
        WHERE NOT EXISTS (SELECT 1 FROM forked g WHERE g.parent = f.doc_id)""",
    "ledger_branches": f"""WITH RECURSIVE {_FORK}, climb AS (SELECT doc_id AS tip, doc_id, parent, block_index, 1 AS n, true AS ok FROM forked f
          WHERE NOT EXISTS (SELECT 1 FROM forked g WHERE g.parent = f.doc_id)
          UNION ALL SELECT tip, p.doc_id, p.parent, p.block_index, n + 1, ok AND c.block_index = p.block_index + 1 FROM climb c JOIN forked p ON p.doc_id = c.parent)
        SELECT sha256(CAST(tip AS VARCHAR)) AS tip, CAST(n AS BIGINT) AS blocks, CASE WHEN ok AND block_index = 0 THEN 'valid' ELSE 'index_order' END AS outcome
        FROM climb WHERE parent < 0""",
    "incident_reports": f"""{_A}, {_EVIDENCE}, n AS (SELECT alert_id, count(*) AS k FROM ev GROUP BY 1)
        SELECT alert_id, threat_type, stage_name AS stages, CASE WHEN final_score > 0.85 AND model_p > 0.85 AND stage_name = 'lateral_movement'
          THEN 'HOST_ISOLATE,PACKET_DROP' WHEN final_score > 0.85 AND model_p > 0.85 AND stage_name = 'command_and_control' THEN 'PACKET_DROP' ELSE '' END AS actions,
          k AS evidence_packets FROM alerts LEFT JOIN n USING (alert_id)""",
    "recorded_digests": """SELECT CAST(doc_id AS VARCHAR) AS artifact, CASE WHEN lang = 'de' THEN 'unrecorded' WHEN source = 'src0' THEN 'missing' ELSE 'changed' END AS problem
        FROM documents WHERE (lang = 'de' AND source <> 'src0') OR (lang <> 'de' AND source = 'src0') OR (lang <> 'de' AND source <> 'src0' AND doc_id % 9 = 4)""",
}
