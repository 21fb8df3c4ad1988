"""Incidents, block intervals and planned response actions.  Nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import argmax
from flowspark.operators.ordered import ROWS_PER_TASK, ordered

SECOND = 1_000_000

# Action thresholds, block lifetime and response gate.
BLOCK_SCORE, ALERT_SCORE = 0.85, 0.50
BLOCK_TTL_US = 300 * SECOND
GATE_SCORE = 0.85
GATE_STAGES = ["lateral_movement", "command_and_control"]
MANAGEMENT_SUBNET, DECOY_PORT = "192.168.1.0/24", 8088


def decide(score: Column, threshold: float) -> Column:
    return score >= threshold


def high_risk(score: Column, confirmed: Column, calibrated: Column, threshold: float = BLOCK_SCORE) -> Column:
    return (score >= threshold) & (confirmed | ~calibrated)


def respond(alerts: DataFrame, block: float = BLOCK_SCORE, alert: float = ALERT_SCORE) -> DataFrame:
    """Incident rows: alerts with ``action``; scores under the alert level make none."""
    action = F.when(F.col("final_score") >= block, "BLOCK_IP").when(F.col("final_score") >= alert, "ALERT")
    return alerts.withColumn("action", action).where("action IS NOT NULL")


def number_incidents(incidents: DataFrame, order: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``incident_no`` in event order and the text ``incident_id``."""
    rows = ordered(incidents, [], order, limit).running(incident_no=("sum", F.lit(1).cast("bigint"))).done()
    seconds = F.floor(F.col("ts_us") / SECOND)
    number = F.col("incident_no").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return rows.withColumn("incident_id", F.concat(F.lit("INC-"), seconds.cast("string"), F.lit("-"), padded))


def recent_incidents(incidents: DataFrame, n: int = 50) -> DataFrame:
    return incidents.orderBy(F.desc("incident_no")).limit(max(n, 0))


def block_intervals(
    hits: DataFrame, unblocks: DataFrame | None = None, ttl_us: int = BLOCK_TTL_US, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Merged block intervals per address: [blocked_us, expires_us), hits and the last hit.

    A hit inside the lifetime refreshes it; a manual unblock ends it.
    """
    events = hits.select("ip", F.col("ts_us"), F.lit(True).alias("_hit"))
    if unblocks is not None:
        events = events.unionByName(unblocks.select("ip", F.col("ts_us"), F.lit(False).alias("_hit")))
    # At one instant the unblock counts first, then one hit.
    events = events.groupBy("ip", "ts_us", "_hit").agg(F.count(F.lit(1)).alias("_n"))
    rows = ordered(events, ["ip"], ["ts_us", "_hit"], limit).lag(_prev_ts="ts_us", _prev_hit="_hit")
    opens = F.col("_hit") & (
        F.col("_prev_ts").isNull() | ~F.col("_prev_hit") | (F.col("ts_us") >= F.col("_prev_ts") + ttl_us)
    )
    rows = rows.with_column("_opens", opens).running(island=("sum", F.col("_opens").cast("bigint")))
    grouped = rows.done().where("island > 0").groupBy("ip", "island")
    merged = grouped.agg(
        F.min("ts_us").alias("blocked_us"),
        F.max(F.when(F.col("_hit"), F.col("ts_us"))).alias("last_hit_us"),
        F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).alias("hits"),
        F.min(F.when(~F.col("_hit"), F.col("ts_us"))).alias("_unblocked"),
    )
    expires = F.least(F.col("last_hit_us") + ttl_us, F.coalesce("_unblocked", F.col("last_hit_us") + ttl_us))
    return merged.select("ip", "blocked_us", "last_hit_us", "hits", expires.alias("expires_us"))


def is_blocked(probes: DataFrame, blocks: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """As-of lookup: add ``blocked``, whether ``ip`` is blocked at ``ts_us``.

    Block intervals of one address do not overlap, so the latest block started at or
    before the probe decides: a running last over the union, not a range join.
    """
    starts = blocks.select(
        "ip", F.col("blocked_us").alias("_t"), F.lit(0).alias("_kind"), F.col("expires_us").alias("_until"),
        F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"),
    )
    asked = probes.select("ip", F.col("ts_us").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_until"), "probe_id")
    rows = ordered(starts.unionByName(asked), ["ip"], ["_t", "_kind", "probe_id"], limit).running(_open=("last", "_until"))
    hit = F.coalesce(F.col("_open") > F.col("_t"), F.lit(False))
    return rows.done().where("_kind = 1").select("probe_id", "ip", F.col("_t").alias("ts_us"), hit.alias("blocked"))


def active_blocks(blocks: DataFrame, at_us: int) -> DataFrame:
    return blocks.where((F.col("blocked_us") <= at_us) & (F.col("expires_us") > at_us))


def gate_response() -> Column:
    """Whether an alert may trigger automatic action."""
    chosen = F.col("stage_set")
    scores = (F.col("attack_p") > GATE_SCORE) & (F.col("model_p") > GATE_SCORE)
    evidence = F.col("confirmed") & F.col("stage_validated") & F.col("calibrated")
    critical = F.size(F.array_except(chosen, F.array(*map(F.lit, GATE_STAGES)))) == 0
    allowed = scores & evidence & (F.size(chosen) > 0) & critical & F.array_contains(chosen, F.col("stage_name"))
    return F.coalesce(allowed, F.lit(False))


def plan_command(action: str, ip: Column, backend: str = "simulated", port: Column | None = None) -> Column:
    """Planned command as an array of words."""
    # Command text per backend.
    words = {
        ("PACKET_DROP", "nft"): ["nft", "add", "rule", "inet", "filter", "input", "ip", "saddr", ip, "drop"],
        ("PACKET_DROP", "iptables"): ["iptables", "-I", "INPUT", "-s", ip, "-j", "DROP"],
        ("PACKET_DROP", "simulated"): ["ebpf-xdp-ctl", "drop-ip", ip],
        ("HOST_ISOLATE", "nft"): ["nft", "add", "rule", "inet", "filter", "forward", "ip", "saddr", ip, "ip", "daddr", "!=", MANAGEMENT_SUBNET, "drop"],
        ("HOST_ISOLATE", "iptables"): ["iptables", "-I", "FORWARD", "-s", ip, "!", "-d", MANAGEMENT_SUBNET, "-j", "DROP"],
        ("HOST_ISOLATE", "simulated"): ["vlan-ctl", "quarantine-vlan", ip],
        ("DECOY_REROUTE", "nft"): ["nft", "add", "rule", "inet", "nat", "prerouting", "ip", "saddr", ip, "tcp", "dport", port, "redirect", "to", str(DECOY_PORT)],
        ("DECOY_REROUTE", "iptables"): ["iptables", "-t", "nat", "-I", "PREROUTING", "-p", "tcp", "-s", ip, "--dport", port, "-j", "REDIRECT", "--to-ports", str(DECOY_PORT)],
        ("DECOY_REROUTE", "simulated"): ["honeypot-rerouter", "--attacker", ip, "--port", str(DECOY_PORT)],
    }[(action, backend)]
    columns = [F.lit(w) if isinstance(w, str) else w.cast("string") for w in words]
    return F.array(*columns)


def plan_actions(alerts: DataFrame, backend: str = "simulated") -> DataFrame:
    """One row per planned action of every alert that passes the gate.

    The gate admits only lateral movement and command-and-control, so a decoy reroute
    never follows from it; its command text exists for callers that plan one.
    """

    def action(name: str, ip: Column, details: Column) -> Column:
        return F.struct(
            F.lit(name).alias("action_type"), ip.alias("target_ip"), plan_command(name, ip, backend).alias("command"), details.alias("details")
        )

    src, dst = F.col("src_ip"), F.col("dst_ip")
    drop = action("PACKET_DROP", src, F.concat(F.lit("dry run: would drop what comes from "), src))
    isolate = action(
        "HOST_ISOLATE", dst, F.concat(F.lit("dry run: would cut off "), dst, F.lit(f" but for {MANAGEMENT_SUBNET}"))
    )
    alone = F.array_distinct("stage_set") == F.array(F.lit("lateral_movement"))
    planned = F.array_compact(F.array(drop, F.when(alone, isolate)))
    gated = alerts.where(gate_response())
    return gated.withColumn("_a", F.explode(planned)).select(*alerts.columns, "_a.*", F.lit(True).alias("dry_run"))


def conformal_set(probs: Column, q: Column, names: list[str]) -> Column:
    """Stages whose probability is at least 1 - q; the best one when none is."""
    needed = F.greatest(F.lit(0.0), F.lit(1.0) - q)
    labels = F.array(*map(F.lit, names))

    def label(i: Column) -> Column:
        return F.coalesce(F.get(labels, i), F.concat(F.lit("stage_"), i.cast("string")))

    included = F.transform(
        F.filter(F.transform(probs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: s["p"] >= needed),
        lambda s: label(s["i"]),
    )
    best = F.array(label(argmax(probs)))
    return F.when(F.size(included) > 0, included).otherwise(best)


def cycle_summary(flows: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Flows, alerts and incidents per processing cycle."""
    processed = flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("flows"))
    raised = alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("action") == "BLOCK_IP").alias("blocks"),
        F.max_by("threat_type", F.struct("start_us", "src_ip", "dst_ip", "src_port")).alias("last_threat"),
    )
    return processed.join(raised, keys, "left").na.fill({"alerts": 0, "blocks": 0})


def incident_report(
    alerts: DataFrame, sets: DataFrame, actions: DataFrame, digests: DataFrame, forecasts: DataFrame | None = None
) -> DataFrame:
    """Alerts enriched with stage set, planned actions, evidence digest and forecast."""
    planned = actions.groupBy("alert_id").agg(F.array_sort(F.collect_list("action_type")).alias("actions"))
    report = (
        alerts.join(sets, "alert_id", "left")
        .join(planned, "alert_id", "left")
        .join(digests, "alert_id", "left")
        .withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))
    )
    return report if forecasts is None else report.join(forecasts, "window", "left")
