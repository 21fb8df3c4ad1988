"""Canonical text and digests.

Canonical form: sorted keys, compact JSON, times as integer microseconds.  Numbers of a report are
fixed-decimal strings, so that every engine prints the same bytes; features are hexadecimal floating
numbers, which name every double exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DECIMALS = 6


def fixed(number: Column, decimals: int = HASH_DECIMALS) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.round(number.cast("double"), decimals).cast(f"decimal(38,{decimals})").cast("string")


def exact(number: Column) -> Column:
    """A double as hexadecimal text, one text for one value: minus zero is zero."""
    x = number.cast("double")
    return F.when(x.isNotNull(), F.format_string("%a", F.when(x == 0, F.lit(0.0)).otherwise(x)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys; every value a string, integer, boolean or array."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def event_fingerprint(src: Column, dst: Column, ts_us: Column, features: list[Column]) -> Column:
    """Digest of one labelled event: endpoints, time and features in order.

    A missing value is the word ``null`` in its place, so that no two events with values in
    different places share a digest; features enter at full precision.
    """
    known = lambda c: F.coalesce(c, F.lit("null"))
    body = F.concat_ws(",", *[known(exact(f)) for f in features])
    return sha256_text(F.concat(F.lit("["), known(src), F.lit(","), known(dst), F.lit(","), known(ts_us.cast("string")), F.lit(",["), body, F.lit("]]")))
