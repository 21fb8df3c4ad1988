"""Packet filters and row validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import signed_log1p
from flowspark.functions.text import norm_name
from flowspark.operators.ordered import ordered

# Background ports and broadcast addresses.
NOISE_PORTS = [53, 5353, 123, 67, 68, 1900, 137, 138]
NOISE_IPS = ["255.255.255.255", "224.0.0.251", "239.255.255.250"]
MULTICAST_PREFIXES = ["224.", "239."]
DNS_PORTS = [53, 5353]
NTP_PORT = 123
DISCOVERY_PORTS = [5353, 1900, 5355, 137, 138]
SMALL_DNS_BYTES = 120
MAX_TIME_S = 1e12


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _either_port(ports: list[int]) -> Column:
    return F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)


def noise_reason(
    filter_dns: bool = True,
    filter_ntp: bool = True,
    filter_broadcast: bool = True,
    ports: list[int] | None = None,
    ips: list[str] | None = None,
) -> Column:
    """Why a packet is background noise, NULL when it is kept.

    With a DNS or NTP flag off, those ports are kept even where the port list has them.
    """
    ports = NOISE_PORTS if ports is None else ports
    ips = NOISE_IPS if ips is None else ips
    src, dst = F.col("src_ip"), F.col("dst_ip")
    broadcast = src.isin(*ips) | dst.isin(*ips) | _any([dst.startswith(p) for p in MULTICAST_PREFIXES])
    exempt = ([] if filter_dns else DNS_PORTS) + ([] if filter_ntp else [NTP_PORT])
    branches = []
    if filter_broadcast:
        branches.append((broadcast, "broadcast"))
    if filter_dns:
        branches.append((_either_port(DNS_PORTS), "dns"))
    if filter_ntp:
        branches.append((_either_port([NTP_PORT]), "ntp"))
    if exempt:
        branches.append((_either_port(exempt), None))
    if ports:
        branches.append((_either_port(ports), "port"))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, reason in branches:
        chain = chain.when(condition, F.lit(reason).cast("string"))
    return chain


def exclude_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop packets between whitelisted address pairs, in either direction."""
    low, high = F.least("a_ip", "b_ip"), F.greatest("a_ip", "b_ip")
    known = pairs.select(low.alias("_low"), high.alias("_high")).distinct()
    match = (F.least("src_ip", "dst_ip") == F.col("_low")) & (F.greatest("src_ip", "dst_ip") == F.col("_high"))
    return df.join(known, match, "left_anti")


def filter_noise(df: DataFrame, pairs: DataFrame | None = None, **flags) -> DataFrame:
    kept = df.where(noise_reason(**flags).isNull())
    return kept if pairs is None else exclude_pairs(kept, pairs)


def is_background(drop_ntp: bool = True, drop_arp: bool = True, drop_small_dns: bool = True) -> Column:
    proto = F.lower(F.coalesce("protocol", F.lit("")))
    dst = F.coalesce("dst_port", F.lit(0))
    tests = [dst.isin(*DISCOVERY_PORTS)]
    if drop_ntp:
        tests.append((proto == "udp") & F.coalesce(_either_port([NTP_PORT]), F.lit(False)))
    if drop_arp:
        tests.append(proto.isin("arp", "rarp"))
    if drop_small_dns:
        small = F.col("length") < SMALL_DNS_BYTES
        tests.append((proto == "udp") & F.coalesce(_either_port([53]), F.lit(False)) & small)
    return _any(tests)


def prune_background(df: DataFrame, **flags) -> DataFrame:
    return df.where(~is_background(**flags))


def prune_stats(df: DataFrame, **flags) -> DataFrame:
    pruned = F.count_if(is_background(**flags))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("examined"),
        pruned.alias("pruned"),
        (total - pruned).alias("retained"),
        F.when(total > 0, pruned / total).otherwise(F.lit(0.0)).alias("prune_ratio"),
    )


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(features: Column) -> Column:
    return F.forall(features, _finite)


def validate_flows(df: DataFrame, keys: list[str], width: int = 16, raw: bool = True) -> DataFrame:
    """Add ``error``: the first failed check of a scoring request row, else NULL.

    ``df`` holds ``features`` (array), ``timestamp`` (seconds) and ``seq``; time must not
    go back within ``keys`` in ``seq`` order.
    """
    rows = ordered(df, keys, ["seq"]).lag(_before="timestamp").done()
    t = F.col("timestamp")
    value = F.transform("features", lambda x: F.abs(signed_log1p(x, None)) if raw else F.abs(x))
    bad_time = ~_finite(t) | (t < 0) | (t > MAX_TIME_S)
    error = (
        F.when(F.size("features") != width, "feature_count")
        .when(~all_finite(F.col("features")), "nonfinite_feature")
        .when(bad_time, "timestamp_range")
        .when(t < F.col("_before"), "timestamp_order")
        .when(F.array_max(value) > 100, "feature_range")
    )
    return rows.withColumn("error", error).drop("_before")


def training_row_reason(features: Column, seconds: Column) -> Column:
    """Reason a labelled row is rejected, else NULL."""
    return (
        F.when(~F.forall(features, lambda x: _finite(x) & (x >= 0)), "invalid_numeric")
        .when(F.array_max(F.transform(features, F.log1p)) > 100, "numeric_range")
        .when(~_finite(seconds) | (seconds < 0) | (seconds > MAX_TIME_S), "timestamp_range")
    )


def split_quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their ``reason``."""
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def drop_repeated_headers(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(norm_name(F.coalesce(label, F.lit(""))) != "label")


def check_chronology(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, negative times and steps back in arrival order."""
    rows = ordered(df, keys, ["seq"]).lag(_before="ts_us").done()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(F.col("ts_us").isNull() | (F.col("ts_us") < 0)).alias("bad_times"),
        F.count_if(F.col("ts_us") < F.col("_before")).alias("steps_back"),
    )
