"""Packets to bidirectional flows, and the statistics of a flow.

A conversation is an unordered endpoint pair plus protocol.  Its packets are cut where
the gap reaches the idle timeout or after an RST: neither needs state, only the previous
packet.  A segment shorter than the active timeout is one flow, or two when packets follow
the FINs of both sides; plain window facts decide that.  Only a segment that lasts longer,
or closes by FINs twice, needs the greedy cut of :func:`cut_segments`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.packets import byte_entropy, entropy_class, tcp_flag
from flowspark.operators.long_segments import cut_long_segments
from flowspark.operators.ordered import ROWS_PER_TASK, Ordered, largest_group, ordered

CONVERSATION = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
FLOW = [*CONVERSATION, "segment", "part"]
SECOND = 1_000_000
ENTROPY_BYTES = 4096


def conversation_key(packets: DataFrame) -> DataFrame:
    """Add the unordered endpoint pair and which endpoint sent the packet."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    keyed = packets.withColumn("_lo", F.least(src, dst)).withColumn("_hi", F.greatest(src, dst))
    return keyed.select(
        "*",
        F.col("_lo.ip").alias("lo_ip"),
        F.col("_lo.port").alias("lo_port"),
        F.col("_hi.ip").alias("hi_ip"),
        F.col("_hi.port").alias("hi_port"),
        (src == F.col("_lo")).alias("from_lo"),
    ).drop("_lo", "_hi")


def largest_conversation(packets: DataFrame) -> int:
    """Packets of the busiest conversation: an upper bound for every flow."""
    return largest_group(conversation_key(packets), CONVERSATION)


def _segmented(packets: DataFrame, idle_us: int, reset_closes: bool, limit: int, largest: int | None) -> Ordered:
    keyed = conversation_key(packets)
    reset = tcp_flag(F.col("tcp_flags"), "RST") & (F.col("protocol") == "tcp")
    rows = ordered(keyed, CONVERSATION, ["ts_us", "seq"], limit, largest)
    rows = rows.lag(_prev_ts=F.col("ts_us"), _prev_rst=reset)
    new = F.col("_prev_ts").isNull() | (F.col("ts_us") - F.col("_prev_ts") >= idle_us)
    if reset_closes:
        new = new | F.col("_prev_rst")
    # A position per conversation: later comparisons and minima are on one integer.
    rows = rows.running(segment=("sum", new.cast("bigint")), pos=("sum", F.lit(1).cast("bigint")))
    return rows.select(*[c for c in rows.df.columns if c not in ("_prev_ts", "_prev_rst")])


def sessionize(
    packets: DataFrame, idle_us: int, limit: int = ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Idle-gap sessions only: ``segment`` counts from 1 inside each conversation."""
    return _segmented(packets, idle_us, False, limit, largest).done()


def cut_segments(active_us: int):
    """Greedy flow starts of one segment, as positions reached by jumping.

    From a flow starting at i the next one starts after the later of the first FINs of
    both sides, or at the first packet ``active_us`` later, whichever comes first.
    """

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts_us", "seq"], kind="stable")
        times = frame["ts_us"].to_numpy()
        n = len(times)
        position = np.arange(n)

        def upcoming(mask):
            return np.minimum.accumulate(np.where(mask, position, n)[::-1])[::-1]

        fin, lo = frame["_fin"].to_numpy(), frame["from_lo"].to_numpy()
        both = np.maximum(upcoming(fin & lo), upcoming(fin & ~lo))
        following = np.minimum(both + 1, np.searchsorted(times, times + active_us, side="left"))
        starts, i = np.zeros(n, dtype=np.int64), 0
        while i < n:
            starts[i] = 1
            i = int(following[i])
        return frame.drop(columns="_fin").assign(part=np.cumsum(starts) - 1)

    return cut


def assemble_flows(
    packets: DataFrame, idle_us: int, active_us: int, limit: int = ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Packets with ``segment`` and ``part``; (conversation, segment, part) is a flow.

    ``pos`` numbers the packets of a conversation in (time, arrival) order.
    """
    if largest is None:
        largest = largest_conversation(packets)
    rows = _segmented(packets, idle_us, True, limit, largest)
    segment = [*CONVERSATION, "segment"]
    fin = tcp_flag(F.col("tcp_flags"), "FIN") & (F.col("protocol") == "tcp")
    at, lo = F.col("pos"), F.col("from_lo")
    facts = {
        "_n": F.count(F.lit(1)),
        "_span": F.max("ts_us") - F.min("ts_us"),
        "_first_lo": F.min(F.when(fin & lo, at)),
        "_first_hi": F.min(F.when(fin & ~lo, at)),
        "_last_lo": F.max(F.when(fin & lo, at)),
        "_last_hi": F.max(F.when(fin & ~lo, at)),
    }
    if rows.sliced:
        summary = rows.done().groupBy(*segment).agg(*[c.alias(n) for n, c in facts.items()])
        marked = rows.done().join(summary, segment)
    else:
        # Already partitioned by conversation: a sort, but no shuffle, and bounded segments.
        whole = Window.partitionBy(*segment)
        span = F.max("ts_us").over(whole) - F.min("ts_us").over(whole)
        over = {n: c.over(whole) for n, c in facts.items() if n != "_span"} | {"_span": span}
        marked = rows.df.select("*", *[c.alias(n) for n, c in over.items()])
    both = F.col("_first_lo").isNotNull() & F.col("_first_hi").isNotNull()
    marked = marked.withColumn("_close", F.when(both, F.greatest("_first_lo", "_first_hi")))
    again = F.coalesce((F.col("_last_lo") > F.col("_close")) & (F.col("_last_hi") > F.col("_close")), F.lit(False))
    greedy = (F.col("_span") >= active_us) | again
    part = F.when(F.col("_close").isNotNull() & (at > F.col("_close")), 1).otherwise(0).cast("bigint")
    helpers = [*facts, "_close"]
    plain = marked.where(~greedy).withColumn("part", part).drop(*helpers)
    work = marked.where(greedy & (F.col("_n") <= limit)).withColumn("_fin", fin).drop(*helpers)
    schema = T.StructType([f for f in work.schema if f.name != "_fin"] + [T.StructField("part", T.LongType())])
    out = plain.unionByName(work.groupBy(*segment).applyInPandas(cut_segments(active_us), schema))
    if rows.sliced:
        huge = marked.where(greedy & (F.col("_n") > limit)).withColumn("_fin", fin).drop(*helpers)
        if not huge.isEmpty():
            out = out.unionByName(cut_long_segments(huge, segment, active_us, limit))
    return out


def _rate(amount: Column) -> Column:
    seconds = F.col("duration_us") / F.lit(float(SECOND))
    return F.when(F.col("duration_us") > 0, amount / seconds).otherwise(F.lit(0.0))


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def flow_table(assembled: DataFrame) -> DataFrame:
    """One row per flow: endpoints, times, counts and handshake counters.

    One partially aggregated pass: both sides are summed under the conversation's own
    orientation and swapped at the end if the high endpoint spoke first.
    """
    lo, hi = F.col("from_lo"), ~F.col("from_lo")
    tcp = F.col("protocol") == "tcp"
    flag = {n: tcp & tcp_flag(F.col("tcp_flags"), n) for n in ("SYN", "ACK", "RST", "FIN", "PSH")}
    syn = flag["SYN"] & ~flag["ACK"]
    syn_ack = flag["SYN"] & flag["ACK"]

    def sided(name: str, make) -> list[Column]:
        return [make(lo).alias(f"_lo_{name}"), make(hi).alias(f"_hi_{name}")]

    position, ts = F.col("pos"), F.col("ts_us")
    stats = assembled.groupBy(*FLOW).agg(
        F.min_by("from_lo", position).alias("_first_lo"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("last_us"),
        F.count_if(flag["ACK"] & ~flag["SYN"]).alias("ack_count"),
        F.count_if(flag["RST"]).alias("rst_count"),
        F.count_if(flag["FIN"]).alias("fin_count"),
        *sided("packets", F.count_if),
        *sided("bytes", lambda s: F.coalesce(F.sum(F.when(s, F.col("length").cast("bigint"))), F.lit(0))),
        *sided("span", lambda s: F.max(F.when(s, F.col("ts_us"))) - F.min(F.when(s, F.col("ts_us")))),
        *sided("syn", lambda s: F.count_if(s & syn)),
        *sided("syn_ack", lambda s: F.count_if(s & syn_ack)),
        *sided("first_syn", lambda s: F.min(F.when(s & syn, position))),
        *sided("first_syn_us", lambda s: F.min(F.when(s & syn, ts))),
        *sided("first_syn_ack", lambda s: F.min(F.when(s & syn_ack, position))),
    )

    def side(name: str, forward: bool) -> Column:
        near, far = (f"_lo_{name}", f"_hi_{name}") if forward else (f"_hi_{name}", f"_lo_{name}")
        return F.when(F.col("_first_lo"), F.col(near)).otherwise(F.col(far))

    chosen = stats.select(
        *FLOW,
        F.when(F.col("_first_lo"), F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("src_ip"),
        F.when(F.col("_first_lo"), F.col("hi_ip")).otherwise(F.col("lo_ip")).alias("dst_ip"),
        F.when(F.col("_first_lo"), F.col("lo_port")).otherwise(F.col("hi_port")).alias("src_port"),
        F.when(F.col("_first_lo"), F.col("hi_port")).otherwise(F.col("lo_port")).alias("dst_port"),
        "_first_lo",
        "start_us",
        "last_us",
        (F.col("last_us") - F.col("start_us")).alias("duration_us"),
        side("packets", True).alias("fwd_packets"),
        side("packets", False).alias("bwd_packets"),
        side("bytes", True).alias("fwd_bytes"),
        side("bytes", False).alias("bwd_bytes"),
        side("span", True).alias("_fwd_span"),
        side("span", False).alias("_bwd_span"),
        side("syn", True).alias("syn_count"),
        side("syn_ack", False).alias("syn_ack_count"),
        side("first_syn", True).alias("_first_syn"),
        side("first_syn_us", True).alias("_first_syn_us"),
        side("first_syn_ack", False).alias("_first_syn_ack"),
        "ack_count",
        "rst_count",
        "fin_count",
    )
    return chosen.withColumn("syn_ack_ratio", F.col("syn_count") / (F.col("ack_count") + 1))


def with_features(flows: DataFrame, variant: str = "sorted") -> DataFrame:
    """Add the sixteen statistics to a flow table.

    ``sorted`` takes the mean gap of sorted times, which is the span over n - 1;
    ``arrival`` expects the means of :func:`arrival_gaps` to be joined on already.
    """
    fwd, bwd = F.col("fwd_packets"), F.col("bwd_packets")
    packets, octets = fwd + bwd, F.col("fwd_bytes") + F.col("bwd_bytes")

    def gap(span: str, n: Column) -> Column:
        return F.when(n > 1, F.col(span) / (n - 1)).otherwise(F.lit(0.0))

    means = {
        "iat_mean_us": gap("duration_us", packets),
        "fwd_iat_mean_us": gap("_fwd_span", fwd),
        "bwd_iat_mean_us": gap("_bwd_span", bwd),
    }
    if variant == "arrival":
        means = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in means}
        down_up = F.when(fwd > 0, bwd / fwd).otherwise(F.lit(0.0))
    else:
        down_up = bwd / F.greatest(fwd, F.lit(1))
    return flows.withColumns(
        {
            "fwd_len_mean": _mean(F.col("fwd_bytes"), fwd),
            "bwd_len_mean": _mean(F.col("bwd_bytes"), bwd),
            "bytes_per_s": _rate(octets),
            "packets_per_s": _rate(packets),
            **means,
            "fwd_packets_per_s": _rate(fwd),
            "bwd_packets_per_s": _rate(bwd),
            "avg_packet_size": octets / F.greatest(packets, F.lit(1)),
            "down_up_ratio": down_up,
        }
    )


def gaps(
    assembled: DataFrame, order: list[str], limit: int = ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Packets with ``forward`` (sent by the endpoint that opened the flow), ``gap_us`` to the
    previous packet of the flow and ``side_gap_us`` to the previous one of the same side."""
    rows = ordered(assembled, FLOW, order, limit, largest).lag(_prev="ts_us").running(_opener=("first", "from_lo"))
    rows = rows.with_column("gap_us", F.col("ts_us") - F.col("_prev"))
    whole = rows.with_column("forward", F.col("from_lo") == F.col("_opener")).done().drop("_prev", "_opener")
    sides = ordered(whole, [*FLOW, "forward"], order, limit, largest)
    return sides.lag(_prev="ts_us").with_column("side_gap_us", F.col("ts_us") - F.col("_prev")).done().drop("_prev")


def arrival_gaps(assembled: DataFrame, limit: int = ROWS_PER_TASK, largest: int | None = None) -> DataFrame:
    """Mean inter-arrival times in arrival order, backward steps dropped."""
    rows = gaps(assembled, ["seq"], limit, largest)

    def mean(gap: str, keep: Column) -> Column:
        return F.avg(F.when(keep & (F.col(gap) >= 0), F.col(gap)))

    return rows.groupBy(*FLOW).agg(
        mean("gap_us", F.lit(True)).alias("iat_mean_us"),
        mean("side_gap_us", F.col("forward")).alias("fwd_iat_mean_us"),
        mean("side_gap_us", ~F.col("forward")).alias("bwd_iat_mean_us"),
    )


def flow_features(assembled: DataFrame, variant: str = "sorted", largest: int | None = None) -> DataFrame:
    """Flow table with all sixteen statistics, ``sorted`` or ``arrival`` variant."""
    flows = flow_table(assembled)
    if variant == "arrival":
        flows = flows.join(arrival_gaps(assembled, largest=largest), FLOW, "left")
    return with_features(flows, variant)


def handshake(assembled: DataFrame, flows: DataFrame, variant: str = "sorted") -> DataFrame:
    """Add ``handshake_complete`` and ``handshake_latency_us`` to a flow table.

    The completing packet is the first forward ACK after a forward SYN and a backward
    SYN-ACK.  In the ``arrival`` variant any later forward packet with ACK counts.
    """
    tcp = F.col("protocol") == "tcp"
    ack = tcp & tcp_flag(F.col("tcp_flags"), "ACK")
    if variant == "sorted":
        ack = ack & ~tcp_flag(F.col("tcp_flags"), "SYN")
    opened = flows.where(F.col("_first_syn").isNotNull() & F.col("_first_syn_ack").isNotNull()).select(
        *FLOW, "_first_lo", F.greatest("_first_syn", "_first_syn_ack").alias("_open"), F.col("_first_syn_us").alias("_syn_ts")
    )
    acks = assembled.where(ack).select(*FLOW, "from_lo", "ts_us", F.col("pos").alias("_at"))
    done = (
        acks.join(opened, FLOW)
        .where((F.col("from_lo") == F.col("_first_lo")) & (F.col("_at") > F.col("_open")))
        .groupBy(*FLOW)
        .agg(F.min("ts_us").alias("_ack_ts"), F.first("_syn_ts").alias("_syn_ts"))
    )
    return flows.join(done, FLOW, "left").select(
        *flows.columns,
        F.col("_ack_ts").isNotNull().alias("handshake_complete"),
        F.when(F.col("_ack_ts").isNotNull(), F.greatest(F.col("_ack_ts") - F.col("_syn_ts"), F.lit(0))).alias("handshake_latency_us"),
    )


def micro_vector(assembled: DataFrame, entropy: DataFrame | None = None) -> DataFrame:
    """Packet-level half of the edge vector, sixteen numbers per flow."""
    tcp = F.col("protocol") == "tcp"
    names = ["SYN", "ACK", "RST", "FIN", "PSH"]
    counts = assembled.groupBy(*FLOW).agg(
        F.coalesce(F.avg("ttl"), F.lit(64.0)).alias("ttl_mean"),
        F.coalesce(F.var_pop("ttl"), F.lit(0.0)).alias("ttl_var"),
        F.coalesce(F.avg("tcp_window"), F.lit(0.0)).alias("window_mean"),
        F.coalesce(F.var_pop("tcp_window"), F.lit(0.0)).alias("window_var"),
        *[F.count_if(tcp & tcp_flag(F.col("tcp_flags"), n)).alias(n.lower()) for n in names],
    )
    if entropy is not None:
        counts = counts.join(entropy.select(*FLOW, "payload_entropy"), FLOW, "left")
    else:
        counts = counts.withColumn("payload_entropy", F.lit(0.0))
    total = F.greatest(F.lit(1), sum((F.col(n.lower()) for n in names), F.lit(0)))
    vector = F.array(
        *[F.col(c).cast("double") for c in ("ttl_mean", "ttl_var", "window_mean", "window_var")],
        *[F.col(n.lower()).cast("double") for n in names],
        *[F.col(n.lower()) / total for n in names],
        F.col("syn") / (F.col("ack") + 1),
        F.coalesce("payload_entropy", F.lit(0.0)),
    )
    return counts.select(*FLOW, vector.alias("micro"))


def macro_vector(
    assembled: DataFrame, flows: DataFrame, limit: int = ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Flow-level half of the edge vector, times in seconds, gaps of sorted times."""
    rows = gaps(assembled, ["ts_us", "seq"], limit, largest)
    spread = rows.groupBy(*FLOW).agg(
        *[
            (f(F.when(keep, F.col(gap))) / float(SECOND)).alias(f"{name}_{kind}")
            for name, gap, keep in (
                ("all", "gap_us", F.lit(True)),
                ("fwd", "side_gap_us", F.col("forward")),
                ("bwd", "side_gap_us", ~F.col("forward")),
            )
            for kind, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
    fwd, bwd = F.col("fwd_packets"), F.col("bwd_packets")
    octets, packets = F.col("fwd_bytes") + F.col("bwd_bytes"), fwd + bwd
    seconds = F.greatest(F.col("duration_us") / float(SECOND), F.lit(1e-6))
    vector = F.array(
        seconds,
        fwd.cast("double"),
        bwd.cast("double"),
        _mean(F.col("fwd_bytes"), fwd),
        _mean(F.col("bwd_bytes"), bwd),
        octets / seconds,
        packets / seconds,
        *[F.coalesce(f"{n}_{k}", F.lit(0.0)) for n in ("all", "fwd", "bwd") for k in ("mean", "std")],
        bwd / F.greatest(fwd, F.lit(1)),
        octets / F.greatest(packets, F.lit(1)),
        octets.cast("double"),
    )
    return flows.join(spread, FLOW).select(*FLOW, vector.alias("macro"))


def edge_vectors(
    assembled: DataFrame, flows: DataFrame, entropy: DataFrame | None = None, largest: int | None = None
) -> DataFrame:
    """The 32-number edge vector per flow: micro then macro."""
    micro = micro_vector(assembled, entropy)
    macro = macro_vector(assembled, flows, largest=largest)
    return micro.join(macro, FLOW).select(*FLOW, F.concat("micro", "macro").alias("edge_vector"))


def flow_entropy(
    assembled: DataFrame, max_bytes: int = ENTROPY_BYTES, limit: int = ROWS_PER_TASK, largest: int | None = None
) -> DataFrame:
    """Byte entropy of the first ``max_bytes`` payload bytes of each flow, both sides.

    The byte budget is part of the feature; it also bounds what one group collects.
    """
    loaded = assembled.where(F.length("payload") > 0).select(*FLOW, "ts_us", "seq", "payload")
    rows = ordered(loaded, FLOW, ["ts_us", "seq"], limit, largest)
    rows = rows.running(_through=("sum", F.length("payload").cast("bigint")))
    before = F.col("_through") - F.length("payload")
    used = rows.done().where(before < max_bytes)
    piece = F.substring(F.col("payload"), F.lit(1), (F.lit(max_bytes) - before).cast("int"))
    whole = used.groupBy(*FLOW).agg(
        F.array_sort(F.collect_list(F.struct("ts_us", "seq", piece.alias("piece")))).alias("_pieces")
    )
    hexed = F.array_join(F.transform("_pieces", lambda p: F.hex(p["piece"])), "")
    sized = whole.withColumn("_bytes", F.unhex(hexed))
    entropy = sized.select(*FLOW, byte_entropy("_bytes").alias("payload_entropy"), F.length("_bytes").cast("bigint").alias("payload_bytes"))
    flows = assembled.select(*FLOW).distinct().join(entropy, FLOW, "left")
    filled = flows.na.fill({"payload_entropy": 0.0, "payload_bytes": 0})
    return filled.withColumn("entropy_class", entropy_class(F.col("payload_entropy")))
