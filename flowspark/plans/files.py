"""File sources and sinks over the tables: written once under the shared folder, read back."""

from __future__ import annotations

import socket
import struct
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions.text import canonical_label
from flowspark.operators import calibrate, evaluate, evidence, filters, prepare
from flowspark.operators.graph import batch_ordinals
from flowspark.plans import records as rec
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS, FEATURES, PACKET, SPLITS
from flowspark.session import fresh_dir, materialized
from flowspark.sources import artifacts, captures, csvflows
from flowspark.sources import records as files


def _labelled(spark, sf):
    """Flows as labelled CSV rows under the public header spellings."""
    flows = v.flows_v(spark, sf)
    label = F.when(F.col("dst_port") == 445, "SMB probe").otherwise("BENIGN")
    named = [F.col(c).cast("string").alias(h) for c, h in zip(FEATURE_COLUMNS, FEATURES)]
    seconds = (F.col("last_us").cast("decimal(38,6)") / F.lit(1000000)).cast("decimal(38,6)").cast("string")
    return flows.select(F.col("src_ip").alias("Src IP"), F.col("dst_ip").alias("Dst IP"), seconds.alias("Timestamp"), label.alias("Label"), "protocol", *named)


def _csv(spark, sf, name):
    """One folder of two column orders: TCP flows as they are, all others with the columns turned round."""
    path = fresh_dir(spark, name)
    rows = _labelled(spark, sf)
    columns = [c for c in rows.columns if c != "protocol"]
    for part, order in ((rows.where("protocol = 'tcp'"), columns), (rows.where("protocol <> 'tcp'"), columns[::-1])):
        part.select(order).write.mode("append").option("header", True).csv(path)
    return path


def flow_csv_scan(spark, sf):
    """Strict alias-resolved scan of all flows as CSV files of two headers."""
    rows = csvflows.read_flow_csv(spark, _csv(spark, sf, "flow-csv"))
    return rows.select("src_ip", "dst_ip", "timestamp", "label", "fwd_packets", "bwd_packets", "fwd_bytes")


def feature_csv_scan(spark, sf):
    """Feature-only scan with reject reasons; the dash label column is kept as the family."""
    rows = csvflows.read_feature_csv(spark, _csv(spark, sf, "feature-csv")).withColumn("reason", csvflows.feature_row_reason())
    return rows.groupBy("label", F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("fwd_bytes").cast("bigint")).alias("fwd_bytes")
    )


def manifest_scan(spark, sf):
    """Four captures, one per split, read through a manifest."""
    rows = _labelled(spark, sf)
    sources = []
    for i, split in enumerate(SPLITS):
        path = fresh_dir(spark, f"capture-{split}")
        part = rows.where(F.pmod(F.crc32("Src IP"), F.lit(4)) == i).drop("protocol")
        part.write.option("header", True).csv(path)
        sources.append(dict(group=f"capture{i}", split=split, path=path))
    read = csvflows.read_manifest(spark, sources)
    return read.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("capture").alias("captures"))


def sequence_scan(spark, sf):
    """Request documents of up to 1,000 flows each, every one an array in order."""
    order = ["last_us", "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    flows = batch_ordinals(v.flows_v(spark, sf), [], order, 1000)
    item = F.struct("src_ip", "dst_ip", (F.col("start_us") / 1e6).alias("timestamp"), F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS]).alias("features"))
    docs = flows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row_no", item.alias("flow")))).alias("f"))
    path = fresh_dir(spark, "sequences")
    docs.select(F.transform("f", lambda x: x["flow"]).alias("flows")).write.option("maxRecordsPerFile", 1).json(path)
    rows = files.read_sequence_json(spark, path)
    return rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum(F.size("features")).alias("values"))


def source_fingerprints(spark, sf):
    """Digests of the documents written one part per language; no part repeats."""
    path = fresh_dir(spark, "parts")
    v.table(spark, sf, "documents").select("lang", "doc_id", "text").repartition("lang").write.partitionBy("lang").json(path)
    prints = materialized(artifacts.file_fingerprints(spark, f"{path}/*/*.json"), "fingerprints")
    twice = artifacts.duplicate_files(prints)
    return prints.agg(F.countDistinct("digest").alias("distinct_files"), F.min(F.length("digest")).alias("digest_chars")).crossJoin(
        twice.agg(F.count(F.lit(1)).alias("repeated"))
    )


def prepared_dataset(spark, sf):
    """Write sorted shards by split and capture, verify the digests, read one split."""
    rows = v.scored_v(spark, sf).withColumn("ts_us", F.col("row_id"))
    path = fresh_dir(spark, "prepared")
    csvflows.write_prepared(rows, path, 2000)
    digests = fresh_dir(spark, "digests")
    csvflows.prepared_digests(spark, path).write.parquet(digests)
    recorded = spark.read.schema("artifact string, digest string").parquet(digests)
    read = csvflows.read_prepared(spark, path, "train", rows.schema, recorded)
    return read.groupBy("capture").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("keys"), F.sum("label").alias("attacks"))


def quarantine_file(spark, sf):
    """Rows outside the daytime go to a quarantine file with their reason."""
    events = v.table(spark, sf, "events")
    reason = F.when(~F.hour("ts").between(8, 18), "timestamp_outside_daytime_capture").when(F.col("value") > 200, "invalid_numeric")
    ok, bad = filters.split_quarantine(events.select("event_id", "event_type", "ts", "value"), reason)
    path = fresh_dir(spark, "quarantine")
    csvflows.write_quarantine(bad.select("event_id", "event_type", "reason"), path)
    read = spark.read.schema("event_id bigint, event_type string, reason string").json(path)
    kept = ok.groupBy("event_type").agg(F.lit("ok").alias("reason"), F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(read.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("rows")))


def _frames(flavour: int):
    """Packets as the lines of capture files of one of four kinds: the bytes of a file, cut at its line feeds.

    Each file ends with a frame that is no IPv4 packet; files of kind 1 lack the last bytes of it.
    """
    order, link, ticks = [("<", 1, 10**6), (">", 101, 10**9), ("<", 1, 10**6), (">", 113, 10**6)][flavour]
    before = {1: b"\0" * 12 + b"\x08\x00", 101: b"", 113: b"\0" * 14 + b"\x08\x00"}[link]
    padded = lambda b: b + b"\0" * (-len(b) % 4)

    def block(kind, body):
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size

    def record(micros, frame):
        if flavour == 2:
            return block(6, struct.pack(order + "IIIII", 0, micros >> 32, micros & 0xFFFFFFFF, len(frame), len(frame)) + padded(frame))
        return struct.pack(order + "IIII", micros // 10**6, micros % 10**6 * (ticks // 10**6), len(frame), len(frame)) + frame

    def packet(r):
        payload = r["payload"] or b""
        if r["protocol"] == "tcp":
            body = struct.pack("!HHIIBBHHH", r["src_port"], r["dst_port"], 0, 0, 0x50, r["tcp_flags"], r["tcp_window"], 0, 0) + payload
        else:
            body = struct.pack("!HHHH", r["src_port"], r["dst_port"], 8 + len(payload), 0) + payload
        ends = socket.inet_aton(r["src_ip"]) + socket.inet_aton(r["dst_ip"])
        return before + struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, r["ttl"], 6 if r["protocol"] == "tcp" else 17, 0) + ends + body

    def run(batches):
        if flavour == 2:
            head = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", link, 0, 0))
        else:
            head = struct.pack(order + "IHHiIII", 0xA1B2C3D4 if ticks == 10**6 else 0xA1B23C4D, 2, 4, 0, 0, 65535, link)
        kept, at = head, 0
        for batch in batches:
            kept += b"".join(record(r["ts_us"], packet(r)) for r in batch.to_pylist())
            at = batch.column("ts_us")[-1].as_py() if batch.num_rows else at
            *lines, kept = kept.split(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])
        # The decoy's last byte is a line feed, which the text writer adds.
        kept += record(at, b"\x12" * 40 + b"\n\n\n\n")
        kept = kept[:-9] if flavour == 1 else kept
        lines = kept.split(b"\n")
        yield pa.RecordBatch.from_arrays([pa.array(lines[:-1] if not lines[-1] else lines, pa.binary())], ["value"])

    return run


def _control_sum(name: str):
    """Sum of a bigint column as a bigint: exact where it fits, modulo 2^64 where it does not."""
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    total = F.sum(F.col(name).cast("decimal(38,0)"))
    return (F.pmod(total + half, whole) - half).cast("bigint")


def capture_scan(spark, sf):
    """Packets written as capture files of four kinds, one of them cut off, beside a file that is none, and read back.

    ``times`` is a control sum of the stamps: exact within a bigint, beyond it modulo 2^64 (in two's complement).
    """
    path = fresh_dir(spark, "captures")
    packets = v.packets_v(spark, sf).withColumn("tcp_flags", F.coalesce("tcp_flags", F.lit(0)))
    for kind in range(4):
        lines = packets.where(F.pmod("seq", F.lit(4)) == kind).mapInArrow(_frames(kind), "value binary")
        lines.select(F.col("value").cast("string").alias("value")).write.mode("append").text(path)
    spark.range(1).select(F.lit("no capture at all, but a line of text").alias("value")).write.mode("append").text(path)
    rows = captures.scan_packets(spark, path)
    found = rows.where("error IS NULL").groupBy(F.col("protocol").alias("kind"), "dst_port", "tcp_flags").agg(
        F.count(F.lit(1)).alias("packets"), _control_sum("ts_us").alias("times"), F.sum("ttl").alias("ttls"), F.sum(F.length("payload")).alias("payload_bytes"), F.countDistinct("src_ip").alias("sources")
    )
    odd = rows.where("error IS NOT NULL").select(F.col("error").alias("kind")).distinct()
    return found.unionByName(odd, allowMissingColumns=True)


def _headed(line: str):
    """Lines behind a header line in every file."""

    def run(batches):
        yield pd.DataFrame({"value": [line]})
        yield from batches

    return run


def quarantine_records(spark, sf):
    """Damaged flow files scanned line by line: what is rejected keeps its file, record and raw text.

    Of seventeen end times, one row lacks its last field, one label has a line break in quotes (which is
    sound), one label is not known.
    """
    flows = _labelled(spark, sf).withColumn("_k", F.pmod(F.expr("CAST(replace(Timestamp, '.', '') AS BIGINT)"), F.lit(17)))
    label = F.when(F.col("_k") == 5, F.lit('"SMB\nprobe"')).when(F.col("_k") == 7, "Mystery").otherwise(F.col("Label"))
    fields = [F.col("`Src IP`"), F.col("`Dst IP`"), F.col("Timestamp"), label, *[F.col(f"`{f}`") for f in FEATURES]]
    line = F.when(F.col("_k") == 3, F.concat_ws(",", *fields[:-1])).otherwise(F.concat_ws(",", *fields))
    path, target = fresh_dir(spark, "damaged"), fresh_dir(spark, "quarantine")
    header = ",".join(["Src IP", "Dst IP", "Timestamp", "Label", *FEATURES])
    flows.select(line.alias("value")).mapInPandas(_headed(header), "value string").write.text(path)
    rows = csvflows.read_record_csv(spark, path).withColumnRenamed("reason", "_width")
    reason = F.coalesce(F.col("_width"), csvflows.known_label_reason(F.col("label"), [*csvflows.EXPORT_LABELS, "SMB probe"]))
    ok, bad = filters.split_quarantine(rows, reason)
    csvflows.write_quarantine(bad.select("file", "record", "reason", "raw"), target)
    read = spark.read.schema("file string, record bigint, reason string, raw string").json(target)
    parts = F.split("raw", ",")
    places = F.count(F.lit(1)).over(Window.partitionBy("file", "record"))
    rejected = read.select("reason", parts[0].alias("src_ip"), parts[1].alias("dst_ip"), parts[2].alias("timestamp"), F.size(parts).alias("fields"), ((places == 1) & (F.col("record") > 1)).alias("placed"))
    kept = ok.select(canonical_label(F.col("label")).alias("reason"), "src_ip", "dst_ip", "timestamp", F.lit(20).alias("fields"), (F.col("record") > 1).alias("placed"))
    return rejected.unionByName(kept)


def export_labels(spark, sf):
    """Rows of every label in exported files of two headers."""
    table = csvflows.label_inventory(spark, [_csv(spark, sf, "label-csv")])
    return table.select("label", "rows")


def ledger_lines(spark, sf):
    """A written ledger verified in the order of its lines, and one with two lines swapped."""
    from flowspark.operators import ledger as lg

    leaves = v.leaves_v(spark, sf).groupBy(F.col("batch").alias("block_index")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf"))).alias("_l"))
    blocks = rec._ledger(spark, sf).join(leaves, "block_index").withColumn("leaf_hashes", F.transform("_l", lambda x: x["leaf"]))
    sound, swapped = fresh_dir(spark, "ledger-sound"), fresh_dir(spark, "ledger-swapped")
    files.write_ledger(blocks, sound)
    turn = F.when(F.col("line_no") == 4, 5).when(F.col("line_no") == 5, 4).otherwise(F.col("line_no"))
    text = spark.read.text(sound).withColumn("line_no", F.get_json_object("value", "$.block_index").cast("bigint")).withColumn("_at", turn)
    text.repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.text(swapped)
    check = lambda path, name: lg.verify_ledger(files.read_ledger_lines(spark, path), order=("file", "line")).select(F.lit(name).alias("ledger"), "block_index", "reason")
    return check(sound, "sound").unionByName(check(swapped, "swapped"))


def ledger_file(spark, sf):
    """Ledger blocks as JSON lines with their leaf arrays, read back and verified."""
    from flowspark.operators import ledger as lg

    leaves = v.leaves_v(spark, sf).groupBy(F.col("batch").alias("block_index")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf"))).alias("_l"))
    blocks = rec._ledger(spark, sf).join(leaves, "block_index").withColumn("leaf_hashes", F.transform("_l", lambda x: x["leaf"]))
    path = fresh_dir(spark, "ledger-json")
    files.append_ledger(blocks, path)
    checked = lg.verify_ledger(files.read_ledger(spark, path))
    return checked.select("block_index", "timestamp", "leaf_count", "reason")


def report_file(spark, sf):
    path = fresh_dir(spark, "report")
    files.write_report(v.rounded(evaluate.binary_metrics(v.scored_v(spark, sf), 0.5, ["split"]), ["precision", "recall"]), path)
    return spark.read.schema("split string, events bigint, tp bigint, fp bigint, `precision` double, recall double").json(path)


def window_state_file(spark, sf):
    """Window states by capture without the open last window."""
    path = fresh_dir(spark, "states")
    states = v.states_v(spark, sf).withColumn("capture", F.concat(F.lit("c"), F.col("capture").cast("string")))
    artifacts.write_window_states(states, path)
    rows = artifacts.read_window_states(spark, path)
    return rows.groupBy("capture").agg(F.count(F.lit(1)).alias("windows"), F.max("window").alias("last_window"))


def calibration_file(spark, sf):
    """Write-once calibration artifact, loaded under its identity and used."""
    path = fresh_dir(spark, "calibration")
    benign = v.scored_v(spark, sf).where("split = 'calibration' AND label = 0").select(F.col("p").alias("score"))
    stages = v.stage_probs_v(spark, sf).select("y", "probs")
    artifacts.save_calibration(spark, path, benign, "a" * 64, "flow-by-flow", 0.1, ["calibration"], "b" * 64, stages)
    scores, loaded = artifacts.load_calibration(spark, path, "a" * 64, "flow-by-flow", 0.1, 8)
    support = artifacts.calibration_diagnostics(loaded).select("stage", "support")
    return support.crossJoin(calibrate.conformal_q(scores, 0.1).select("n", "q"))


def evidence_file(spark, sf):
    """Evidence packets in sorted alert buckets, read back per alert."""
    rows = evidence.evidence(rec._alerts(spark, sf), v.packets_v(spark, sf), rec.PAD, rec.BUCKET)
    path = fresh_dir(spark, "evidence")
    files.write_evidence(rows, path)
    schema = rows.withColumn("alert_bucket", F.lit("")).schema
    read = files.read_evidence(spark, path, schema)
    return read.groupBy("alert_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("seq").alias("seqs"))


def export_inventory(spark, sf):
    """Full inventory of two exports of all flows, one of them without addresses."""
    rows = _labelled(spark, sf)
    base = fresh_dir(spark, "inventory")
    rows.drop("protocol").write.option("header", True).csv(f"{base}/full/flows")
    rows.drop("protocol", "Src IP", "Dst IP").write.option("header", True).csv(f"{base}/features/flows")
    table = csvflows.audit_inventory(spark, [f"{base}/full/flows", f"{base}/features/flows"], None)
    return table.drop("file")


def folder_counts(spark, sf):
    """Pages per host as an inventory of files per folder."""
    from flowspark.operators.audit import files_per_folder

    pages = v.table(spark, sf, "pages")
    return files_per_folder(pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("folder"), F.col("url").alias("file")))


def paired_exports(spark, sf):
    """Two exports of the order lines, one with changed taxes, paired by position."""
    from flowspark.operators.audit import compare_exports

    line = v.table(spark, sf, "lineitem").withColumn("file", F.col("l_returnflag"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    position = F.struct(*order)
    left = line.select("file", position.alias("position"), "l_tax", "l_discount", "l_quantity", "l_linestatus")
    right = left.withColumn("l_tax", F.when(F.col("l_quantity") > 40, F.col("l_tax") + 1).otherwise(F.col("l_tax"))).drop("l_linestatus")
    return compare_exports(left, right, ["file"], ["position"])


QUERIES = {
    f.__name__: f
    for f in (
        flow_csv_scan,
        feature_csv_scan,
        manifest_scan,
        sequence_scan,
        source_fingerprints,
        prepared_dataset,
        capture_scan,
        quarantine_file,
        quarantine_records,
        export_labels,
        ledger_lines,
        ledger_file,
        report_file,
        window_state_file,
        calibration_file,
        evidence_file,
        export_inventory,
        folder_counts,
        paired_exports,
    )
}

_F = v.FLOW_CTES
ORACLE = {
    "flow_csv_scan": f"""{_F} SELECT src_ip, dst_ip, CAST(CAST(last_us AS DECIMAL(38, 6)) / 1000000 AS VARCHAR) AS timestamp_raw,
        CASE WHEN dst_port = 445 THEN 'SMB probe' ELSE 'BENIGN' END AS label, CAST(fwd_packets AS VARCHAR) AS fwd_packets,
        CAST(bwd_packets AS VARCHAR) AS bwd_packets, CAST(fwd_bytes AS VARCHAR) AS fwd_bytes FROM flows_v""".replace(
        "CAST(CAST(last_us AS DECIMAL(38, 6)) / 1000000 AS VARCHAR) AS timestamp_raw",
        "(last_us // 1000000) || '.' || lpad(CAST(last_us % 1000000 AS VARCHAR), 6, '0') AS \"timestamp\"",
    ),
    "feature_csv_scan": f"""{_F} SELECT CASE WHEN dst_port = 445 THEN 'SMB probe' ELSE 'BENIGN' END AS label, 'ok' AS outcome, count(*) AS rows,
        CAST(sum(fwd_bytes) AS BIGINT) AS fwd_bytes FROM flows_v GROUP BY 1""",
    "manifest_scan": f"""{_F} SELECT CASE WHEN dst_port = 445 THEN 'SMB probe' ELSE 'BENIGN' END AS label, count(*) AS rows, CAST(4 AS BIGINT) AS captures
        FROM flows_v GROUP BY 1""",
    "sequence_scan": f"{_F} SELECT src_ip, count(*) AS flows, 16 * count(*) AS values FROM flows_v GROUP BY 1",
    "source_fingerprints": """SELECT count(DISTINCT lang) AS distinct_files, CAST(64 AS INT) AS digest_chars, CAST(0 AS BIGINT) AS repeated FROM documents""",
    "prepared_dataset": f"""WITH {v.SCORED} SELECT capture, count(*) AS rows, CAST(sum(row_id) AS BIGINT) AS keys, CAST(sum(label) AS BIGINT) AS attacks
        FROM scored_v WHERE split = 'train' GROUP BY 1""",
    "quarantine_file": """SELECT event_type, CASE WHEN hour(ts) NOT BETWEEN 8 AND 18 THEN 'timestamp_outside_daytime_capture' WHEN value > 200 THEN 'invalid_numeric'
        ELSE 'ok' END AS reason, count(*) AS rows FROM events GROUP BY 1, 2""",
    "capture_scan": f"""WITH {v.PACKETS} SELECT protocol AS kind, dst_port, tcp_flags, count(*) AS packets, CAST(sum(ts_us) AS BIGINT) AS times, CAST(sum(ttl) AS BIGINT) AS ttls,
          CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes, count(DISTINCT src_ip) AS sources FROM packets_v GROUP BY 1, 2, 3
        UNION ALL SELECT unnest(['no IPv4 packet', 'truncated record', 'unknown magic']), NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    "quarantine_records": f"""{_F} SELECT CASE last_us % 17 WHEN 3 THEN 'row_width' WHEN 5 THEN 'SMB probe' WHEN 7 THEN 'unknown_label'
          ELSE CASE WHEN dst_port = 445 THEN 'SMB probe' ELSE 'BENIGN' END END AS reason, src_ip, dst_ip,
        (last_us // 1000000) || '.' || lpad(CAST(last_us % 1000000 AS VARCHAR), 6, '0') AS "timestamp", CASE WHEN last_us % 17 = 3 THEN 19 ELSE 20 END AS fields, true AS placed FROM flows_v""",
    "export_labels": f"{_F} SELECT CASE WHEN dst_port = 445 THEN 'SMB probe' ELSE 'BENIGN' END AS label, count(*) AS rows FROM flows_v GROUP BY 1",
    "ledger_lines": """WITH b AS (SELECT DISTINCT doc_id // 16 AS b FROM documents) SELECT 'sound' AS ledger, b AS block_index, CAST(NULL AS VARCHAR) AS reason FROM b
        UNION ALL SELECT 'swapped', b, CASE WHEN b IN (4, 5) THEN 'index_sequence' WHEN b = 6 THEN 'previous_hash' END FROM b""",
    "ledger_file": """SELECT doc_id // 16 AS block_index, (1704067200 + (doc_id // 16) * 15) || '.5' AS "timestamp", count(*) AS leaf_count,
        CAST(NULL AS VARCHAR) AS reason FROM documents GROUP BY 1, 2""",
    "report_file": f"""WITH {v.SCORED}, c AS (SELECT split, count(*) AS events, count(*) FILTER (p >= 0.5 AND label = 1) AS tp,
          count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (label = 1) AS pos FROM scored_v GROUP BY 1)
        SELECT split, events, tp, fp, round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(pos, 1), 6) AS recall FROM c""",
    "window_state_file": f"""WITH {v.STATES}, m AS (SELECT *, max("window") OVER (PARTITION BY capture) AS w FROM states_v)
        SELECT 'c' || capture AS capture, count(*) AS windows, max("window") AS last_window FROM m WHERE "window" < w GROUP BY 1""",
    "calibration_file": f"""WITH {v.STAGE_PROBS}, {v.SCORED}, b AS (SELECT p, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM scored_v
          WHERE split = 'calibration' AND label = 0),
        q AS (SELECT max(n) AS n, coalesce(max(p) FILTER (rn = ceil((n + 1) * CAST(0.9 AS DOUBLE))), 1.0)::DOUBLE AS q FROM b)
        SELECT CAST(y AS INT) AS stage, count(*) AS support, n, q FROM stage_probs_v, q GROUP BY 1, 3, 4""",
    "evidence_file": f"{rec._A}, {rec._EVIDENCE} SELECT alert_id, count(*) AS packets, CAST(sum(seq) AS BIGINT) AS seqs FROM ev GROUP BY 1",
    "export_inventory": f"""{_F} SELECT 'full' AS folder, CAST(20 AS INT) AS columns, '' AS missing, '' AS repeated, count(*) AS rows, CAST(0 AS BIGINT) AS wrong_column_count,
          CAST(0 AS BIGINT) AS invalid_numeric, CAST(0 AS BIGINT) AS invalid_ip, CAST(0 AS BIGINT) AS empty_label FROM flows_v
        UNION ALL SELECT 'features', 18, 'src_ip,dst_ip', '', count(*), 0, 0, 0, 0 FROM flows_v""",
    "folder_counts": """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS folder, count(*) AS files FROM pages GROUP BY 1 ORDER BY 1""",
    "paired_exports": """SELECT l_returnflag AS file, CAST(3 AS INT) AS common_columns, count(*) AS checked_rows, count(*) FILTER (l_quantity <= 40) AS matching_rows, CAST(0 AS BIGINT) AS unpaired_rows
        FROM lineitem GROUP BY 1""",
}
