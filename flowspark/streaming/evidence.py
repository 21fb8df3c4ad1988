"""Evidence packets of alerts while both are still coming in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.evidence import PAD_US
from flowspark.operators.flows import CONVERSATION, conversation_key


def stream_evidence(alerts: DataFrame, packets: DataFrame, *, longest_us: int, pad_us: int = PAD_US, delay_us: int = 0) -> DataFrame:
    """Stream-stream form of :func:`flowspark.operators.evidence.evidence`.

    Packets of either direction between an alert's endpoints, from ``pad_us`` before its start to
    ``pad_us`` after its time.  An alert lasts ``longest_us`` at most, so both sides of the join have a
    bound in event time and leave the state behind the watermark.  An alert whose interval holds no
    packet comes out once, with nulls, when no packet of it can come any more.
    """
    delay = f"{delay_us} microseconds"
    seconds = lambda us: F.expr(f"INTERVAL '{us // 1_000_000}.{us % 1_000_000:06d}' SECOND")
    wanted = conversation_key(alerts.withColumn("_alert_ts", F.timestamp_micros("alert_us")).withWatermark("_alert_ts", delay))
    wanted = wanted.select("alert_id", "_alert_ts", F.col("start_us").alias("_start"), *[F.col(c).alias(f"_{c}") for c in CONVERSATION])
    seen = conversation_key(packets.withColumn("_packet_ts", F.timestamp_micros("ts_us")).withWatermark("_packet_ts", delay))
    same = [F.col(c) == F.col(f"_{c}") for c in CONVERSATION]
    near = (F.col("_packet_ts") >= F.col("_alert_ts") - seconds(longest_us + pad_us)) & (F.col("_packet_ts") <= F.col("_alert_ts") + seconds(pad_us))
    for part in (*same, F.col("ts_us") >= F.col("_start") - pad_us):
        near = near & part
    return wanted.join(seen, near, "leftOuter").select("alert_id", *packets.columns)
