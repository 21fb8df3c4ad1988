"""Merkle trees, proofs, ledgers and forecasts against direct computation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evidence, forecast
from flowspark.operators import ledger as lg


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_root(leaves):
    while len(leaves) > 1:
        leaves = [sha(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]) for i in range(0, len(leaves), 2)]
    return leaves[0]


SIZES = [1, 2, 3, 7, 8, 1024, 1025, 2049]


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(b, i, sha(f"{b}/{i}")) for b, n in enumerate(SIZES) for i in range(n)]
    return spark.createDataFrame(rows, "batch int, pos bigint, leaf string")


def test_roots_across_block_rounds(leaves):
    got = {r.batch: (r.root, r.leaves) for r in evidence.merkle_root(leaves, ["batch"]).collect()}
    for b, n in enumerate(SIZES):
        assert got[b] == (tree_root([sha(f"{b}/{i}") for i in range(n)]), n)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2500])
def test_root_without_batch_keys(spark, n):
    rows = [(i, sha(f"x/{i}")) for i in range(n)]
    root = evidence.merkle_root(spark.createDataFrame(rows, "pos bigint, leaf string"), []).collect()
    assert [(r.root, r.leaves) for r in root] == [(tree_root([h for _, h in rows]), n)]


def test_proofs(leaves):
    small = leaves.where("batch < 5")
    roots = evidence.merkle_root(small, ["batch"])
    proofs = evidence.merkle_proof(small, ["batch"]).join(roots, "batch")
    checked = proofs.select("batch", "pos", F.size("proof").alias("n"), evidence.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")).alias("ok"))
    rows = checked.collect()
    assert len(rows) == sum(SIZES[:5]) and all(r.ok for r in rows)
    assert {r.n for r in rows if r.batch == 4} == {3} and {r.n for r in rows if r.batch == 0} == {0}
    wrong = proofs.select(evidence.verify_proof(F.sha2("leaf", 256), F.col("proof"), F.col("root")).alias("ok"))
    assert not any(r.ok for r in wrong.collect())


def _blocks(spark, n=7):
    rows, previous = [], lg.GENESIS
    for i in range(n):
        items = [sha(f"{i}-{j}") for j in range(i + 1)]
        head = f'{{"block_index":{i},"leaf_count":{len(items)},"merkle_root":"{tree_root(items)}","prev_block_hash":"{previous}","timestamp":{1700000000 + i}.25}}'
        rows.append((i, f"{1700000000 + i}.25", previous, tree_root(items), len(items), items, sha(head)))
        previous = sha(head)
    return spark.createDataFrame(rows, "block_index bigint, timestamp string, prev_block_hash string, merkle_root string, leaf_count bigint, leaf_hashes array<string>, block_hash string")


@pytest.mark.parametrize("limit", [3, 1000])
def test_ledger_verification(spark, limit):
    good = _blocks(spark)
    assert {r.reason for r in lg.verify_ledger(good, limit=limit).collect()} == {None}
    for column, value, reason in [
        ("leaf_count", F.col("leaf_count") + 1, "leaf_count"),
        ("timestamp", F.lit("1.5"), "block_hash"),
        ("block_hash", F.sha2("block_hash", 256), "block_hash"),
        ("leaf_hashes", F.reverse("leaf_hashes"), "merkle_root"),
        ("block_hash", F.lit(None).cast("string"), "block_hash"),
        ("prev_block_hash", F.lit(None).cast("string"), "block_hash"),
        ("leaf_count", F.lit(None).cast("bigint"), "leaf_count"),
    ]:
        bad = good.withColumn(column, F.when(F.col("block_index") == 3, value).otherwise(F.col(column)))
        got = {r.block_index: r.reason for r in lg.verify_ledger(bad, limit=limit).collect()}
        assert got[3] == reason and got[2] is None
    gone = lg.verify_ledger(good.where("block_index <> 4"), limit=limit).collect()
    assert {r.block_index: r.reason for r in gone}[5] == "index_sequence"


def test_relink_in_chunks(spark):
    blocks = _blocks(spark)
    headers = blocks.select(F.col("block_index").alias("position"), "leaf_count", "merkle_root", "timestamp")
    for rows in (2, 1000):
        got = {r.block_index: r.block_hash for r in lg.relink(headers, rows).collect()}
        assert got == {r.block_index: r.block_hash for r in blocks.collect()}


def test_branches(spark):
    rows = [("a", lg.GENESIS, 0), ("b", "a", 1), ("c", "b", 2), ("d", "b", 3), ("e", "nowhere", 9)]
    got = {r.tip: (r.blocks, r.outcome) for r in lg.ledger_branches(spark.createDataFrame(rows, "block_hash string, prev_block_hash string, block_index bigint")).collect()}
    assert got == {"c": (3, "valid"), "d": (3, "index_order"), "e": (1, "missing_parent")}


def test_evidence_bounds(spark, packets):
    rows = packets((94.9, {}), (95, {}), (100, dict(src_ip="10.0.0.2", dst_ip="10.0.0.1", src_port=80, dst_port=40000)), (115, {}), (115.1, {}), (100, dict(src_port=1)), (101, dict(protocol="udp")))
    alert = spark.createDataFrame([("x", "10.0.0.1", "10.0.0.2", 40000, 80, "tcp", 100_000_000, 110_000_000)],
                                  "alert_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_us bigint, alert_us bigint")
    for bucket in (3_000_000, 60_000_000):
        got = evidence.evidence(alert, rows, bucket_us=bucket)
        assert sorted(r.seq for r in got.collect()) == [1, 2, 3]
        assert sorted(r.seq for r in evidence.evidence(alert, rows, bucket_us=bucket, ports=False).collect()) == [1, 2, 3, 5, 6]
    digest = evidence.evidence_digest(evidence.evidence(alert, rows), F.concat_ws(":", "seq")).first()
    assert digest.evidence_sha256 == tree_root([sha(str(i)) for i in (1, 2, 3)])


def test_window_pairs_never_bridge_a_gap(spark):
    states = spark.createDataFrame([("a", w, [float(w)]) for w in [*range(6), *range(10, 16)]], "capture string, window bigint, state array<double>")
    pairs = forecast.forecast_pairs(states).collect()
    assert sorted(r.window for r in pairs) == [0, 1, 2, 10, 11, 12]
    assert all([t[0] for t in r.targets] == [r.window + 1.0, r.window + 2.0, r.window + 3.0] for r in pairs)


@pytest.mark.parametrize("slice_windows", [1, 2, 4096])
def test_reanchoring(spark, slice_windows):
    states = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("a", 1, [2.0, 2.0]), ("a", 3, [10.0, 10.0])], "capture string, window bigint, state array<double>")
    one = F.array(F.lit(1.0), F.lit(1.0))
    got = {r.window: r for r in forecast.reanchor(states, one, one, slice_windows=slice_windows).collect()}
    gain = 100.05 / 102.05
    assert got[1].prior_mse == 1.0 and got[1].anchor == pytest.approx([1 + gain] * 2)
    assert [got[w].gap for w in (0, 1, 3)] == [True, False, True] and got[3].anchor == [10.0, 10.0]


def test_reanchoring_slices_agree(spark):
    states = spark.createDataFrame([(c, w, [float((w * 7 + c) % 5), float(w % 3)]) for c in (0, 1) for w in range(40) if w != 17], "capture int, window bigint, state array<double>")
    whole, cut = ({(r.capture, r.window): r.anchor for r in forecast.reanchor(states, slice_windows=n).collect()} for n in (4096, 3))
    assert whole.keys() == cut.keys()
    assert all(whole[k] == pytest.approx(cut[k]) for k in whole)
