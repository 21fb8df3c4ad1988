"""Evidence packets of alerts, state hashes and Merkle commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.hashing import canonical_json, exact, fixed, sha256_text
from flowspark.operators.ordered import ROWS_PER_TASK, ordered
from flowspark.session import checkpointed

SECOND = 1_000_000
PAD_US = 5 * SECOND
BLOCK_LEVELS = 10  # leaves fold 2**10 at a time inside one task


def evidence(
    alerts: DataFrame, packets: DataFrame, pad_us: int = PAD_US, bucket_us: int = 60 * SECOND, ports: bool = True
) -> DataFrame:
    """Packets of either direction between an alert's endpoints, from ``pad_us`` before its
    start to ``pad_us`` after its time, ends included.

    The equality key is the conversation and a time bucket, so a long-lived or busy
    conversation spreads over its buckets; the exact bounds follow as a filter.
    """
    src = F.concat_ws("|", *[F.col(c).cast("string") for c in (["src_ip", "src_port"] if ports else ["src_ip"])])
    dst = F.concat_ws("|", *[F.col(c).cast("string") for c in (["dst_ip", "dst_port"] if ports else ["dst_ip"])])

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_a", F.least(src, dst)).withColumn("_b", F.greatest(src, dst))

    lo, hi = F.col("start_us") - pad_us, F.col("alert_us") + pad_us
    wanted = keyed(alerts).select(
        "alert_id", "_a", "_b", F.col("protocol").alias("_p"), lo.alias("_from"), hi.alias("_to"),
        F.explode(F.sequence(F.floor(lo / bucket_us), F.floor(hi / bucket_us))).alias("_bucket"),
    )
    tagged = keyed(packets).withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us)).withColumn("_p", F.col("protocol"))
    key = ["_a", "_b", "_bucket", *(["_p"] if ports else [])]
    joined = tagged.join(wanted if ports else wanted.drop("_p"), key)
    inside = joined.where((F.col("ts_us") >= F.col("_from")) & (F.col("ts_us") <= F.col("_to")))
    return inside.select("alert_id", *packets.columns)


def _next_level(nodes: Column) -> Column:
    """Hash neighbours pairwise; an odd last one pairs with itself."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) + 1) / 2).cast("int") - 1)

    def parent(i: Column) -> Column:
        left = F.get(nodes, 2 * i)
        return F.sha2(F.concat(left, F.coalesce(F.get(nodes, 2 * i + 1), left)), 256)

    return F.transform(pairs, parent)


def merkle_root(leaves: DataFrame, batch: list[str], pos: str = "pos", leaf: str = "leaf", max_leaves: int | None = None) -> DataFrame:
    """Root per batch, its parent rule being sha256 over the two hex texts.

    A round folds aligned blocks of 2**10 neighbours inside tasks, so a batch of any size
    is done after log1024 rounds and no task ever holds more than one block.
    """
    width = 1 << BLOCK_LEVELS
    sized = leaves.groupBy(*batch).agg(F.count(F.lit(1)).alias("leaves"))
    if max_leaves is None:
        max_leaves = sized.agg(F.max("leaves")).first()[0] or 0
    nodes = leaves.select(*batch, F.col(pos).alias("_pos"), F.col(leaf).alias("_hash"))
    rounds = 1
    while width**rounds < max_leaves:
        rounds += 1
    for step in range(rounds):
        block = F.floor(F.col("_pos") / width).cast("bigint")
        grouped = nodes.groupBy(*batch, block.alias("_block")).agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_hash"))).alias("_rows")
        )
        level = F.transform("_rows", lambda r: r["_hash"])
        folded = grouped.withColumn("_nodes", level)
        if step < rounds - 1:
            # Batches that already fit one block stop at size 1; others fold all levels, so
            # a short last block keeps pairing with itself like its neighbours' levels do.
            spread = sized.select(*batch, (F.col("leaves") > width ** (step + 1)).alias("_more"))
            folded = folded.join(spread, batch) if batch else folded.crossJoin(F.broadcast(spread))  # one row
        else:
            folded = folded.withColumn("_more", F.lit(False))
        # Expressions, not a per-level shuffle: the fold stays inside the task.
        root = F.aggregate(
            F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)),
            F.col("_nodes"),
            lambda acc, _: F.when((F.size(acc) == 1) & ~F.col("_more"), acc).otherwise(_next_level(acc)),
        )
        nodes = folded.select(*batch, F.col("_block").alias("_pos"), F.get(root, F.lit(0)).alias("_hash"))
        if step < rounds - 1:
            nodes = checkpointed(nodes)
    return nodes.select(*batch, F.col("_hash").alias("root")).join(sized, batch) if batch else nodes.select(F.col("_hash").alias("root")).crossJoin(sized)


def merkle_levels(leaves: DataFrame, batch: list[str], pos: str = "pos", leaf: str = "leaf") -> DataFrame:
    """Every node of every tree: (batch, level, pos, hash), level 0 being the leaves."""
    current = leaves.select(*batch, F.lit(0).alias("level"), F.col(pos).alias("pos"), F.col(leaf).alias("hash"))
    most = leaves.groupBy(*batch).count().agg(F.max("count")).first()[0] or 1
    out, level = current, 0
    while most > 1:
        level += 1
        sides = current.groupBy(*batch, F.floor(F.col("pos") / 2).cast("bigint").alias("_p")).agg(
            F.min(F.struct("pos", "hash")).alias("_l"), F.max(F.struct("pos", "hash")).alias("_r")
        )
        # A one-node level is a root: batches that have reached it drop out.
        alone = current.groupBy(*batch).agg(F.count(F.lit(1)).alias("_size"))
        grown = sides.join(alone.where("_size > 1"), batch) if batch else sides.crossJoin(F.broadcast(alone.where("_size > 1")))
        current = grown.select(
            *batch, F.lit(level).alias("level"), F.col("_p").alias("pos"), F.sha2(F.concat("_l.hash", "_r.hash"), 256).alias("hash")
        )
        if level % 4 == 0:
            current = checkpointed(current)
        out = out.unionByName(current)
        most = (most + 1) // 2
    return out


def merkle_proof(leaves: DataFrame, batch: list[str], pos: str = "pos", leaf: str = "leaf") -> DataFrame:
    """Inclusion proof of every leaf: one (level, sibling, side) struct per level."""
    levels = checkpointed(merkle_levels(leaves, batch, pos, leaf))
    depth = levels.groupBy(*batch).agg(F.max("level").alias("_depth"))
    steps = leaves.select(*batch, F.col(pos).alias("pos"), F.col(leaf).alias("leaf")).join(depth, batch)
    steps = steps.withColumn("level", F.explode(F.when(F.col("_depth") > 0, F.sequence(F.lit(0), F.col("_depth") - 1)).otherwise(F.array().cast("array<int>"))))
    steps = steps.withColumn("_at", F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    right = F.col("_at") % 2 == 1
    sibling = F.when(right, F.col("_at") - 1).otherwise(F.col("_at") + 1)
    own = levels.select(*batch, "level", F.col("pos").alias("_at"), F.col("hash").alias("_own"))
    other = levels.select(*batch, "level", F.col("pos").alias("_sib"), F.col("hash").alias("_other"))
    found = steps.withColumn("_sib", sibling).join(own, [*batch, "level", "_at"]).join(other, [*batch, "level", "_sib"], "left")
    step = F.struct(
        "level", F.coalesce("_other", "_own").alias("sibling"), F.when(F.col("_at") % 2 == 1, "left").otherwise("right").alias("side")
    )
    proofs = found.groupBy(*batch, "pos").agg(F.array_sort(F.collect_list(step)).alias("proof"))
    every = leaves.select(*batch, F.col(pos).alias("pos"), F.col(leaf).alias("leaf"))
    empty = F.array().cast(proofs.schema["proof"].dataType)
    return every.join(proofs, [*batch, "pos"], "left").withColumn("proof", F.coalesce("proof", empty))


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to; NULL on an unknown side."""
    return F.aggregate(
        proof,
        leaf,
        lambda acc, s: F.when(s["side"] == "left", F.sha2(F.concat(s["sibling"], acc), 256)).when(
            s["side"] == "right", F.sha2(F.concat(acc, s["sibling"]), 256)
        ),
    )


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    return F.coalesce(proof_root(leaf, proof) == root, F.lit(False))


def evidence_digest(packets: DataFrame, frame: Column, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Digest per alert: the Merkle root over its frames in time order, with their count."""
    hashed = packets.select("alert_id", "ts_us", "seq", F.sha2(frame, 256).alias("leaf"))
    rows = ordered(hashed, ["alert_id"], ["ts_us", "seq"], limit).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    roots = merkle_root(rows.withColumn("pos", F.col("_n") - 1), ["alert_id"])
    return roots.select("alert_id", F.col("root").alias("evidence_sha256"), F.col("leaves").alias("packets"))


# The sixteen hashed fields of an alert.
STATE_FIELDS = [
    "alert_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "attack_probability",
    "conformal_p_value", "payload_entropy", "syn_ack_ratio", "conformal_confirmed", "mitre_stage", "stage_name",
    "pcap_hash", "features",
]
STATE_NUMBERS = {"attack_probability", "conformal_p_value", "payload_entropy", "syn_ack_ratio"}


def state_hash(columns: dict[str, Column]) -> Column:
    """Digest of an alert's canonical JSON; ``timestamp`` in microseconds, ``features`` an array."""
    missing = [f for f in STATE_FIELDS if f not in columns]
    if missing:
        raise ValueError(f"state hash needs {missing}")
    fields = {}
    for name in STATE_FIELDS:
        value = columns[name]
        if name in STATE_NUMBERS:
            value = fixed(value)
        elif name == "features":
            value = F.transform(value, exact)
        fields[name] = value
    return sha256_text(canonical_json(fields))
