"""Digests of exact numbers against plain Python."""

import hashlib

from pyspark.sql import functions as F

from flowspark.functions import hashing
from flowspark.operators import evidence


def java_hex(x):
    """A double as the JVM prints it in hexadecimal."""
    if x is None:
        return "null"
    mantissa, exponent = (x + 0.0).hex().split("p")
    head, _, digits = mantissa.partition(".")
    return f"{head}.{digits.rstrip('0') or '0'}p{int(exponent)}"


VALUES = [0.1234561, 0.1234562, 0.0, -0.0, 1.0, 1 / 3, 1e300, 5e-324, 123456789.000001, None]


def test_event_fingerprints_are_exact(spark):
    rows = [(i, f"10.0.0.{i}", None if i == 4 else "b", i * 10, x) for i, x in enumerate(VALUES)]
    frame = spark.createDataFrame(rows, "i int, src string, dst string, ts long, x double")
    digest = hashing.event_fingerprint(F.col("src"), F.col("dst"), F.col("ts"), [F.col("x"), F.col("i")])
    got = {r.i: r.d for r in frame.select("i", digest.alias("d")).collect()}
    for i, src, dst, ts, x in rows:
        text = f"[{src},{dst or 'null'},{ts},[{java_hex(x)},{java_hex(float(i))}]]"
        assert got[i] == hashlib.sha256(text.encode()).hexdigest()
    same = frame.select(hashing.event_fingerprint(F.lit("a"), F.lit("b"), F.lit(1), [F.col("x")]).alias("d")).distinct().count()
    assert same == len(VALUES) - 1  # plus and minus zero are one


def test_state_hash_sees_every_feature(spark):
    base = {f: F.lit("x") for f in evidence.STATE_FIELDS} | {f: F.lit(0.5) for f in evidence.STATE_NUMBERS}
    one = spark.range(1).select(*[evidence.state_hash(base | {"features": F.array(*[F.lit(1.0 + (i == k) * 1e-9) for i in range(16)])}).alias(f"h{k}") for k in range(-1, 16)]).first()
    assert len(set(one)) == 17
