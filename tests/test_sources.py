"""Files in and out: headers, strict rows, manifests, captures, artifacts."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evaluate
from flowspark.schemas import FEATURE_COLUMNS, FEATURES
from flowspark.sources import artifacts, captures, csvflows, records

HEADER = ["src_ip", "dst_ip", "timestamp", "label", *FEATURES]
ROW = ["10.0.0.1", "10.0.0.2", "100.5", "BENIGN", *["1.5"] * 16]


def _csv(path, *rows, header=HEADER, encoding="utf-8"):
    path.write_bytes("\n".join([",".join(header), *[",".join(r) for r in rows], ""]).encode(encoding))
    return str(path)


def test_strict_scan_with_byte_order_mark(spark, tmp_path):
    path = _csv(tmp_path / "a.csv", ROW, ROW, encoding="utf-8-sig")
    row = csvflows.read_flow_csv(spark, path).collect()[1]
    assert (row.src_ip, row.label, row.duration_us, row.down_up_ratio) == ("10.0.0.1", "BENIGN", "1.5", "1.5")


@pytest.mark.parametrize("bad", [ROW[:-1], [*ROW, "9"]])
def test_strict_scan_fails_on_row_width(spark, tmp_path, bad):
    path = _csv(tmp_path / "a.csv", ROW, bad)
    with pytest.raises(Exception, match="number of fields"):
        csvflows.read_flow_csv(spark, path).collect()


def test_header_resolution():
    spaced = [f"  {h.upper().replace('_', ' ')}" for h in HEADER]
    assert csvflows.resolve_columns(spaced)["label"] == 3
    renamed = ["Tot Fwd Pkts" if h == "Total Fwd Packet" else h for h in HEADER]
    assert csvflows.resolve_columns(renamed)["Total Fwd Packet"] == HEADER.index("Total Fwd Packet")
    with pytest.raises(ValueError, match="duplicate"):
        csvflows.resolve_columns([*HEADER, "Label"])
    with pytest.raises(ValueError, match="exactly one"):
        csvflows.resolve_columns(HEADER[1:])
    with pytest.raises(ValueError, match="unknown column overrides"):
        csvflows.resolve_columns(HEADER, {"nope": "x"})
    assert csvflows.resolve_columns([*HEADER, "When"], {"timestamp": "When"})["timestamp"] == len(HEADER)
    unused = ["x", "x", *HEADER]
    assert csvflows.resolve_columns(unused, tolerate_unused=True)["src_ip"] == 2


def test_windows_1252_export_and_quarantine(spark, tmp_path):
    attack = [*ROW[:3], "Web Attack – XSS", *ROW[4:]]
    path = _csv(tmp_path / "b.csv", attack, ROW[:-2], ROW, encoding="cp1252")
    rows = csvflows.with_record_numbers(csvflows.read_export_csv(spark, path))
    got = {r.record: (r.label, r.reason) for r in rows.collect()}
    assert got[2] == ("Web Attack – XSS", None) and got[3][1] == "row_width" and got[4] == ("BENIGN", None)
    csvflows.write_quarantine(rows.where("reason IS NOT NULL").select("file", "record", "reason", "raw"), str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first().record == 3


def test_feature_scan_reasons(spark, tmp_path):
    head = [*FEATURES, "Label"]
    path = _csv(tmp_path / "c.csv", [*["1"] * 16, "Benign"], [*["x"] * 16, "Label"], [*["1"] * 15, "-2", "Bot"], [*["1"] * 15, "inf", "Bot"], header=head)
    rows = csvflows.read_feature_csv(spark, path).withColumn("reason", csvflows.feature_row_reason())
    assert sorted(str(r.reason) for r in rows.collect()) == [
        "None", "nonfinite_or_negative_feature", "nonfinite_or_negative_feature", "repeated_header",
    ]


def test_manifest(spark, tmp_path):
    splits = ["train", "validation", "calibration", "test"]
    sources = [dict(group=f"g{i}", split=s, path=_csv(tmp_path / f"{s}.csv", ROW)) for i, s in enumerate(splits)]
    rows = csvflows.read_manifest(spark, sources)
    assert {(r.capture, r.split) for r in rows.collect()} == {(f"g{i}", s) for i, s in enumerate(splits)}
    with pytest.raises(ValueError, match="splits"):
        csvflows.read_manifest(spark, sources[:3])
    with pytest.raises(ValueError, match="exactly once"):
        csvflows.read_manifest(spark, [*sources, sources[0]])
    prints = artifacts.file_fingerprints(spark, str(tmp_path / "*.csv"))
    with pytest.raises(ValueError, match="identical source file"):
        artifacts.assert_no_duplicate_files(prints)


def test_prepared_dataset(spark, tmp_path):
    rows = spark.range(50).select(
        F.when(F.col("id") < 40, "train").otherwise("test").alias("split"), F.lit("c").alias("capture"), (100 - F.col("id")).alias("ts_us"), F.col("id").alias("v")
    )
    path = str(tmp_path / "prepared")
    csvflows.write_prepared(rows, path, 7)
    recorded = csvflows.prepared_digests(spark, path)
    kept = spark.createDataFrame(recorded.collect(), recorded.schema)
    got = csvflows.read_prepared(spark, path, "train", rows.schema, kept)
    assert got.count() == 40 and got.rdd.getNumPartitions() >= 1
    with pytest.raises(Exception, match="(?i)exists"):
        csvflows.write_prepared(rows, path)
    changed = kept.withColumn("digest", F.lit("0" * 64))
    with pytest.raises(ValueError, match="mismatch"):
        csvflows.read_prepared(spark, path, "train", rows.schema, changed)


def test_sequence_json(spark, tmp_path):
    flow = dict(src_ip="a", dst_ip="b", timestamp=1.0, features=[0.5] * 16)
    (tmp_path / "s.json").write_text(json.dumps(dict(flows=[flow, dict(flow, timestamp=2.0)]), indent=1))
    rows = records.read_sequence_json(spark, str(tmp_path / "s.json")).orderBy("seq").collect()
    assert [(r.seq, r.timestamp, len(r.features)) for r in rows] == [(0, 1.0, 16), (1, 2.0, 16)]


def _frame(proto, body, ethernet=True):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 61, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 9])) + body
    return (b"\0" * 12 + b"\x08\x00" + ip) if ethernet else ip


def _capture(path, frames, order="<", linktype=1):
    data = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, linktype)
    for t, frame in frames:
        data += struct.pack(order + "IIII", int(t), round(t % 1 * 1e6), len(frame), len(frame)) + frame
    path.write_bytes(data)


@pytest.mark.parametrize("order", ["<", ">"])
def test_capture_files(spark, tmp_path, order):
    tcp = struct.pack("!HHIIBBHHH", 4000, 80, 0, 0, 0x50, 0x12, 512, 0, 0) + b"hello"
    udp = struct.pack("!HHHH", 5000, 53, 12, 0) + b"dns!"
    frames = [(10.25, _frame(6, tcp)), (11, _frame(17, udp)), (12, _frame(1, b"ping")), (13, b"\0" * 12 + b"\x08\x06" + b"arp" * 9)]
    _capture(tmp_path / "a.pcap", frames, order)
    _capture(tmp_path / "b.pcap", [(10, _frame(6, tcp, False)), (110, _frame(6, tcp, False))], order, 101)
    rows = captures.read_packets(spark, str(tmp_path / "*.pcap"))
    a = [r for r in rows.orderBy("file", "seq").collect() if r.file.endswith("a.pcap")]
    assert [(r.seq, r.protocol, r.src_port, r.dst_port) for r in a] == [(0, "tcp", 4000, 80), (1, "udp", 5000, 53), (2, "icmp", 0, 0)]
    assert (a[0].ts_us, a[0].tcp_flags, a[0].tcp_window, a[0].ttl, bytes(a[0].payload), a[0].length) == (10_250_000, 0x12, 512, 61, b"hello", 59)
    assert bytes(a[1].payload) == b"dns!" and a[1].tcp_flags is None
    plain = captures.read_packets(spark, str(tmp_path / "a.pcap"), name_icmp=False)
    assert {r.protocol for r in plain.collect()} == {"tcp", "udp", "other"}
    from flowspark.operators import flows

    b = rows.where(F.col("file").endswith("b.pcap"))
    assert flows.flow_table(flows.assemble_flows(b, 15_000_000, 120_000_000)).count() == 2


def _ng_block(order, kind, body):
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("order", ["<", ">"])
def test_large_captures_are_read_in_splits(spark, tmp_path, small_splits, order):
    """Payloads of zeros, line feeds and look-alike headers, cut at every place by small splits."""
    rng = random.Random(order)
    sent, data = [], struct.pack(order + "IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)
    section = _ng_block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    ng = section + _ng_block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0)) + _ng_block(order, 1, struct.pack(order + "HHI", 101, 0, 0))
    for i in range(400):
        body = rng.choice([b"\n", b"\0", bytes(rng.randrange(256) for _ in range(7)), struct.pack(order + "IIII", 9, 9, 9, 9)]) * rng.randrange(1, 60)
        frame = _frame(17, struct.pack("!HHHH", i, 53, 8 + len(body), 0) + body)
        nanos = 1_700_000_000 * 10**9 + i * 10**8 + 5000
        data += struct.pack(order + "IIII", nanos // 10**9, nanos % 10**9, len(frame), len(frame)) + frame
        micros = nanos // 1000
        number, stamp, inner = (0, nanos, frame) if i % 3 else (1, micros, frame[14:])
        ng += _ng_block(order, 6, struct.pack(order + "IIIII", number, stamp >> 32, stamp & 0xFFFFFFFF, len(inner), len(inner)) + inner + b"\0" * (-len(inner) % 4))
        sent.append((i, micros, "udp", i, body))
    for name, content in (("a.pcap", data), ("b.pcap", data + b"\n"), ("c.pcap", data[:-1]), ("d.pcapng", ng)):
        (tmp_path / name).write_bytes(content)
    assert len(data) > 10 * 3000
    rows = captures.scan_packets(spark, str(tmp_path / "*")).orderBy("file", "seq").collect()
    files = {n: [r for r in rows if r.file.endswith(n)] for n in ("a.pcap", "b.pcap", "c.pcap", "d.pcapng")}
    told = lambda rs: [(r.seq, r.ts_us, r.protocol, r.src_port, bytes(r.payload)) for r in rs if r.error is None]
    assert told(files["a.pcap"]) == sent and told(files["d.pcapng"]) == sent and told(files["b.pcap"]) == sent and told(files["c.pcap"]) == sent[:-1]
    assert [(r.error, r.length) for r in files["b.pcap"] if r.error] == [("truncated record", 1)]
    assert [r.error for r in files["c.pcap"] if r.error] == ["truncated record"]
    assert not [r for n in ("a.pcap", "d.pcapng") for r in files[n] if r.error]


def test_what_is_no_packet_is_an_error_row(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"not a capture at all")
    _capture(tmp_path / "y.pcap", [(1, b"\0" * 12 + b"\x86\xdd" + b"six" * 9)], linktype=1)
    _capture(tmp_path / "z.pcap", [(1, b"abc")], linktype=147)
    rows = captures.scan_packets(spark, str(tmp_path / "*.pcap")).orderBy("file").collect()
    assert [r.error for r in rows] == ["unknown magic", "no IPv4 packet", "unknown link type"]
    assert captures.read_packets(spark, str(tmp_path / "*.pcap")).count() == 0


def test_files_of_several_headers(spark, tmp_path):
    _csv(tmp_path / "a b.csv", ROW)
    turned = ["Tot Fwd Pkts" if h == "Total Fwd Packet" else h for h in HEADER][::-1]
    _csv(tmp_path / "c.csv", [str(i) for i in range(16)] + ["Bot", "7.5", "10.0.0.4", "10.0.0.3"], header=turned, encoding="utf-8-sig")
    _csv(tmp_path / "d.csv", ["10.0.0.9", *ROW[1:]])
    rows = csvflows.read_flow_csv(spark, str(tmp_path)).orderBy("src_ip").collect()
    assert [(r.src_ip, r.label, r.duration_us, r.fwd_packets) for r in rows] == [("10.0.0.1", "BENIGN", "1.5", "1.5"), ("10.0.0.3", "Bot", "15", "14"), ("10.0.0.9", "BENIGN", "1.5", "1.5")]
    counts = csvflows.label_inventory(spark, [str(tmp_path)]).orderBy("label").collect()
    assert [(r.label, r.rows) for r in counts] == [("BENIGN", 2), ("Bot", 1)]
    _csv(tmp_path / "e.csv", ROW[1:], header=HEADER[1:])
    with pytest.raises(ValueError, match="exactly one"):
        csvflows.read_flow_csv(spark, str(tmp_path))


def test_records_keep_their_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    broken = ",".join([*ROW[:3], '"Web\nAttack ""x"""', *ROW[4:]])
    path.write_text("\n".join([",".join(HEADER), ",".join(ROW), broken, ",".join(ROW[:-1]), ",".join([*ROW[:3], "Martian", *ROW[4:]]), ",".join(ROW)]) + "\n")
    rows = csvflows.read_record_csv(spark, str(path)).orderBy("record").collect()
    assert [(r.record, r.label, r.reason) for r in rows] == [(2, "BENIGN", None), (3, 'Web\nAttack "x"', None), (4, "BENIGN", "row_width"), (5, "Martian", None), (6, "BENIGN", None)]
    assert rows[1].raw == broken and rows[2].raw == ",".join(ROW[:-1]) and rows[0].file.endswith("a.csv")
    known = csvflows.known_label_reason(F.col("label"), [*csvflows.EXPORT_LABELS, 'Web Attack "x"'])
    got = csvflows.read_record_csv(spark, str(path)).select(known.alias("k")).where("k IS NOT NULL").collect()
    assert [r.k for r in got] == ["unknown_label"]


def test_ledger_lines_in_file_order(spark, tmp_path):
    from flowspark.operators import ledger as lg

    heads = spark.createDataFrame([(i, 1, f"{i:064x}", f"{i}.5") for i in range(6)], "position long, leaf_count long, merkle_root string, timestamp string")
    blocks = heads.join(lg.relink(heads), "position")
    records.write_ledger(blocks, str(tmp_path / "l"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
    lines.sort(key=lambda x: json.loads(x)["block_index"])
    roots = heads.select(F.col("position").alias("block_index"), F.col("merkle_root").alias("_root"), F.col("leaf_count").alias("_leaves"))
    check = lambda path: [r.reason for r in lg.verify_ledger(records.read_ledger_lines(spark, path), roots, order=("file", "line")).orderBy("line").collect()]
    assert check(str(tmp_path / "l")) == [None] * 6
    swapped = [*lines[:2], lines[3], lines[2], *lines[4:]]
    (tmp_path / "s.json").write_text("\n".join([*swapped, "no block"]) + "\n")
    assert check(str(tmp_path / "s.json")) == [None, None, "index_sequence", "index_sequence", "previous_hash", None, "index_sequence"]
    assert [r.reason for r in lg.verify_ledger(records.read_ledger_lines(spark, str(tmp_path / "s.json")).where("block_index IS NOT NULL"), roots).collect()] == [None] * 6


def test_window_states_are_checked_on_read(spark, tmp_path):
    good = [("a", w, [float(w), 1.0]) for w in (0, 1, 2)]
    for name, odd, message in [("dim", ("b", 0, [1.0]), "dimension"), ("nan", ("b", 0, [float("nan"), 1.0]), "nonfinite"), ("twice", ("a", 2, [1.0, 1.0]), "window order")]:
        path = str(tmp_path / name)
        spark.createDataFrame([*good, odd], artifacts.WINDOW_STATE).write.partitionBy("capture").parquet(path)
        with pytest.raises(Exception, match=message):
            artifacts.read_window_states(spark, path, 2).select("window").collect()
        with pytest.raises(Exception, match=message):
            artifacts.read_window_states(spark, path, 2).count()


def test_calibration_identity(spark, tmp_path):
    benign = spark.range(100).select((F.col("id") / 330).alias("score"))
    stages = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "y int, probs array<double>")
    path = str(tmp_path / "cal")
    args = (benign, "a" * 64, "test", 0.1, ["cal"], "b" * 64, stages)
    artifacts.save_calibration(spark, path, *args)
    scores, loaded = artifacts.load_calibration(spark, path, "a" * 64, "test", 0.1, 3)
    assert scores.count() == 100 and loaded.count() == 3
    support = artifacts.calibration_diagnostics(loaded).orderBy("stage").collect()
    assert [r.support for r in support] == [1, 1, 1] and support[0].confidence_ece == 0
    for wrong in [("b" * 64, "test", 0.1, 3), ("a" * 64, "other", 0.1, 3), ("a" * 64, "test", 0.05, 3), ("a" * 64, "test", 0.1, 8)]:
        with pytest.raises(ValueError):
            artifacts.load_calibration(spark, path, *wrong)
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.save_calibration(spark, path, *args)
    with pytest.raises(ValueError, match="required"):
        artifacts.save_calibration(spark, path + "2", benign, "a" * 64, "test", 0.1, [], "b" * 64)


def test_window_states(spark, tmp_path):
    rows = spark.createDataFrame([("a", w, [float(w), 1.0]) for w in (0, 1, 2)], artifacts.WINDOW_STATE)
    artifacts.write_window_states(rows, str(tmp_path / "w"))
    got = artifacts.read_window_states(spark, str(tmp_path / "w"))
    assert sorted(r.window for r in got.collect()) == [0, 1]
    bad = rows.union(spark.createDataFrame([("a", 3, [1.0])], artifacts.WINDOW_STATE))
    with pytest.raises(ValueError, match="dimension"):
        artifacts.write_window_states(bad, str(tmp_path / "x"))


def test_inventory(spark, tmp_path):
    folder = tmp_path / "TrafficLabelling"
    folder.mkdir()
    good = _csv(folder / "a.csv", ROW, ["x", *ROW[1:]], ROW[:-1], [*ROW[:4], "-1", "nan", *ROW[6:]])
    thin = _csv(folder / "b.csv", ROW[1:], header=HEADER[1:])
    table = csvflows.audit_inventory(spark, [good, thin])
    a, b = table.orderBy("file").collect()
    assert (a.rows, a.wrong_column_count, a.invalid_numeric, a.invalid_ip, a.missing) == (4, 1, 2, 1, "")
    assert b.missing == "src_ip" and b.columns == len(HEADER) - 1
    from flowspark.operators.audit import files_per_folder

    assert [(r.folder, r.files) for r in files_per_folder(table).collect()] == [("TrafficLabelling", 2)]


def test_report_and_export_comparison(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, p double")
    records.write_report(evaluate.binary_metrics(rows, 0.5), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().tp == 1
    from flowspark.operators.audit import compare_exports

    left = spark.createDataFrame([("f", i, i, None if i == 2 else "x", 1) for i in range(6)], "file string, n int, a int, b string, only int")
    right = spark.createDataFrame([("f", i, i + (i == 4), None if i == 2 else "x") for i in range(6)], "file string, n int, a int, b string")
    r = compare_exports(left, right, ["file"], ["n"]).first()
    assert (r.common_columns, r.checked_rows, r.matching_rows) == (2, 6, 5)
    assert compare_exports(left, right, ["file"], ["n"], 4).first().matching_rows == 4


def test_surplus_rows_are_unpaired(spark):
    from flowspark.operators.audit import compare_exports

    left = spark.createDataFrame([("f", i, i) for i in range(5)], "file string, at int, x int")
    got = compare_exports(left, left.where("at < 3"), ["file"], ["at"]).first()
    assert (got.checked_rows, got.matching_rows, got.unpaired_rows) == (3, 3, 2)


def test_capture_scan_adds_up_stamps_beyond_a_bigint(spark, tmp_path):
    from flowspark.plans import files
    from flowspark.plans import views as v

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = {"event_id": F.col("id"), "user_id": F.col("id") % 40, "ts": F.timestamp_micros(F.lit(4_100_000_000_000_000) + F.col("id")), "event_type": F.lit("click"), "value": F.lit(1.5), "props": F.lit('{"k": 1}')}
    spark.range(4000).select([late[f.name].cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for p in v.packets_v(spark, str(tmp_path)).collect():
        want.setdefault((p.protocol, p.dst_port, p.tcp_flags), []).append(p.ts_us)
    got = {(r.kind, r.dst_port, r.tcp_flags): (r.packets, r.times) for r in files.capture_scan(spark, str(tmp_path)).where("packets > 0").collect()}
    assert max(map(sum, want.values())) >= 1 << 63
    assert got == {k: (len(t), (sum(t) + (1 << 63)) % (1 << 64) - (1 << 63)) for k, t in want.items()}


def test_control_sum_is_exact_within_a_bigint(spark):
    from flowspark.plans import files

    rows = spark.createDataFrame([("a", -(1 << 63)), ("b", (1 << 63) - 1), ("c", 5), ("c", -7), ("d", (1 << 63) - 1), ("d", 1), ("e", None)], "k string, x bigint")
    assert {r.k: r.x for r in rows.groupBy("k").agg(files._control_sum("x").alias("x")).collect()} == {"a": -(1 << 63), "b": (1 << 63) - 1, "c": -2, "d": -(1 << 63), "e": None}


def test_exports_of_hot_files_are_compared_without_their_order(spark):
    from flowspark.operators.audit import compare_exports

    left = spark.createDataFrame([("f" if i % 4 else "g", (i * 37) % 200, i % 5) for i in range(200)], "file string, at int, x int")
    right = left.where("at <> 33").withColumn("x", F.col("x") + (F.col("at") >= 150).cast("int"))
    whole, cut = (compare_exports(left, right, ["file"], ["at"], limit=k) for k in (1000, 20))
    first = compare_exports(left, right, ["file"], ["at"], 30, limit=20)
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert sum(r.unpaired_rows for r in cut.collect()) == 1 and {r.checked_rows for r in first.collect()} == {30}
    # Rows were numbered while they were sorted: no exchange of their order for a window.
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_of_the_bytes(spark, tmp_path):
    import gzip
    import hashlib
    import os

    mark, noise = b"\xef\xbb\xbf", random.Random(5).randbytes(300_000)
    made = {
        "mark.json": mark, "feed.json": b"\n", "feeds.json": b"\n\n\n", "open.json": b"a\nb", "closed.json": b"a\nb\n",
        "marked.json": mark + b"a\nb", "marked_closed.json": mark + b"a\r\n\r\n", "mark_feed.json": mark + b"\n", "noise.json": noise, "noise.bin": noise[:-7] + mark + b"\n",
        "packed.gz": gzip.compress(noise), "no_gzip.gz": b"plain\n", "inner.gz.json": b"\xff\xfe\x00\n\x00", "no suffix {a}": noise[:99], "odd.su ffix": b"x\n", "with space%20.json": b"y",
        "lines.json": b"".join(b"%d\n" % i for i in range(30_000)),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = artifacts.file_fingerprints(spark, str(tmp_path)).collect()
    got = {os.path.basename(r.path): (r.length, r.digest) for r in rows}
    assert set(got) == set(made) and len(rows) == len(made)
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items()}
    assert all(r.modificationTime is not None for r in rows)


def test_fingerprints_do_not_hold_a_file(spark, tmp_path):
    """A file longer than a split stays in one task, and its content in no plan."""
    import hashlib

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        data = b"".join(b"%d some line\n" % i for i in range(50_000))
        (tmp_path / "long.json").write_bytes(data)
        prints = artifacts.file_fingerprints(spark, str(tmp_path))
        assert prints.first().digest == hashlib.sha256(data).hexdigest()
        assert "content" not in prints._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
