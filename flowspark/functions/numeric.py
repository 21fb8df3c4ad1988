"""Numeric and array column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.schemas import STAGES

# Normal quantile of the 95% interval, and the feature clip.
Z95 = 1.959963984540054
CLIP = 100.0


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def signed_log1p(x: Column, clip: float | None = CLIP) -> Column:
    value = F.signum(x) * F.log1p(F.abs(x))
    if clip is None:
        return value
    # least and greatest skip NULL, so an unknown value must stay unknown explicitly.
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-clip)), F.lit(clip)))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def encode_ts(seconds: Column, mode: str = "int64_seconds") -> Column:
    """Whole seconds by truncation, directly or after rounding to float32."""
    if mode == "int64_seconds":
        return seconds.cast("bigint")
    if mode == "float32_legacy":
        return seconds.cast("float").cast("bigint")
    raise ValueError(f"unknown time encoding {mode!r}")


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def stage_name(index: Column, prefix: str = "unmapped") -> Column:
    names = F.array(*[F.lit(s) for s in STAGES])
    known = F.when(index.between(0, len(STAGES) - 1), F.get(names, index.cast("int")))
    return F.coalesce(known, F.concat(F.lit(f"{prefix}_"), index.cast("string")))


def wilson(successes: Column, trials: Column) -> Column:
    """Struct(low, high): 95% interval, NULL without trials."""
    n = F.nullif(trials, F.lit(0)).cast("double")
    p = successes / n
    spread = 1 + Z95 * Z95 / n
    centre = (p + Z95 * Z95 / (2 * n)) / spread
    radius = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / spread
    bounds = F.struct(
        F.greatest(F.lit(0.0), centre - radius).alias("low"), F.least(F.lit(1.0), centre + radius).alias("high")
    )
    return F.when(n.isNotNull(), bounds)


def is_close(a, b, rtol: float = 0.0, atol: float = 0.0) -> Column:
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def safe_divide(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Quotient, or ``default`` where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))
