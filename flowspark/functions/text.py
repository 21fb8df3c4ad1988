"""Names, labels, addresses and time text."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def norm_text(name: str) -> str:
    """The same rule for a header known at plan time."""
    return "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def canonical_label(label: Column) -> Column:
    """Trimmed, en and em dash as hyphen, runs of white space as one blank."""
    dashed = F.translate(label, "–—", "--")
    return F.trim(F.regexp_replace(dashed, r"\s+", " "))


@F.pandas_udf(T.StringType())
def _canonical_ipv6(text: pd.Series) -> pd.Series:
    def one(value):
        try:
            return str(ipaddress.ip_address(value.strip()))
        except (ValueError, AttributeError):
            return None

    return text.map(one)


def canonical_ipv4(text: Column) -> Column:
    """Dotted quad without leading zeros, NULL when invalid."""
    octet = "(0|[1-9][0-9]{0,2})"
    trimmed = F.trim(text)
    parts = F.split(trimmed, r"\.")
    in_range = F.forall(parts, lambda p: F.expr("true") & (p.cast("int") <= 255))
    return F.when(trimmed.rlike(rf"^{octet}(\.{octet}){{3}}$") & in_range, trimmed)


def canonical_ip(text: Column, ipv6: bool = True) -> Column:
    """Canonical address text; only values holding a colon visit the Arrow function."""
    if not ipv6:
        return canonical_ipv4(text)
    return F.when(text.contains(":"), _canonical_ipv6(F.when(text.contains(":"), text))).otherwise(
        canonical_ipv4(text)
    )


def repair_capture_time(text: Column, date: Column, first_hour: int = 8, last_hour: int = 18) -> Column:
    """Struct(ts, reason): day-first daytime stamps whose AM/PM was lost.

    Hours before ``first_hour`` move to the afternoon; a different date or an hour
    outside the daytime is a reason, never a guess.
    """
    trimmed = F.trim(text)
    parsed = F.coalesce(
        F.try_to_timestamp(trimmed, F.lit("d/M/yyyy H:m:s")), F.try_to_timestamp(trimmed, F.lit("d/M/yyyy H:m"))
    )
    shifted = F.when(F.hour(parsed) < first_hour, parsed + F.expr("INTERVAL 12 HOURS")).otherwise(parsed)
    reason = (
        F.when(parsed.isNull(), "timestamp_unparsed")
        .when(F.to_date(parsed) != date, "timestamp_date_mismatch")
        .when(~F.hour(shifted).between(first_hour, last_hour), "timestamp_outside_daytime_capture")
    )
    return F.struct(F.when(reason.isNull(), shifted).alias("ts"), reason.alias("reason"))


def event_time_us(
    text: Column, duration_us: Column, fmt: str | None = None, tz: str = "UTC", kind: str = "end"
) -> Column:
    """Microseconds of the flow end from a declared format and zone, or raw seconds."""
    if kind not in ("start", "end"):
        raise ValueError("kind must be start or end")
    if fmt:
        local = F.try_to_timestamp(F.trim(text), F.lit(fmt))
        micros = F.unix_micros(F.to_utc_timestamp(local, tz))
    else:
        micros = F.round(F.expr("1e6D") * F.trim(text).try_cast("double")).cast("bigint")
    return micros + F.round(duration_us).cast("bigint") if kind == "start" else micros
