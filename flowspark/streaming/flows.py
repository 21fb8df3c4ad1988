"""Flow assembly on a packet stream in event time, and windows over the completed flows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.packets import tcp_flag
from flowspark.operators.flows import CONVERSATION, conversation_key, with_features
from flowspark.streaming.replay import Replay, bucket, replayed
from flowspark.streaming.source import use_rocksdb, with_event_time

#: What is summed per side, and the packets' marks.
SUMS = ["packets", "bytes", "syn", "syn_ack"]
MARKS = ["syn", "syn_ack", "ack", "rst", "fin"]
SIDES = ("lo", "hi")
#: Of an open flow: times, who spoke first, sides that sent FIN, counters, the handshake so far.
OPEN = ["start", "last", "first_lo", "fin_lo", "fin_hi", "ack", "rst", "fin", "syn_us", "answered", "done_us"]
OPEN += [f"{s}_{c}" for s in SIDES for c in (*SUMS, "first", "last")]
NONE = -1
FLOW_ROW = (
    "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_us bigint, last_us bigint, duration_us bigint, "
    "fwd_packets bigint, bwd_packets bigint, fwd_bytes bigint, bwd_bytes bigint, _fwd_span bigint, _bwd_span bigint, "
    "syn_count bigint, syn_ack_count bigint, ack_count bigint, rst_count bigint, fin_count bigint, syn_ack_ratio double, "
    "handshake_complete boolean, handshake_latency_us bigint, ended_ts timestamp"
)


def _upcoming(mask: np.ndarray) -> np.ndarray:
    """The next place at or after each one where ``mask`` holds; the length where none does."""
    n = len(mask)
    return np.append(np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1], n)


def _latest(mask: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)


def _first_at_least(times: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First place in [low, high) whose time is ``value`` or later, else high; one search per element."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        early = open_ & (times[np.minimum(middle, len(times) - 1)] < value)
        low = np.where(early, middle + 1, low)
        high = np.where(open_ & ~early, middle, high)


class _Packets:
    """Packets sorted by (conversation, time, arrival) with running totals and next places of each mark."""

    def __init__(self, frame: pd.DataFrame, conversation: np.ndarray, idle_us: int):
        order = np.lexsort((frame["seq"].to_numpy(), frame["ts_us"].to_numpy(), conversation))
        self.c, self.t = conversation[order], frame["ts_us"].to_numpy()[order]
        self.lo = frame["from_lo"].to_numpy(bool)[order]
        marks = {m: frame[m].to_numpy(bool)[order] for m in MARKS}
        octets, n = frame["bytes"].to_numpy(np.int64)[order], len(order)
        side = {"lo": self.lo, "hi": ~self.lo}
        # A new flow must begin here: another conversation, an idle gap, or the place after a reset.
        breaks = np.ones(n + 1, bool)
        if n:
            breaks[1:-1] = (np.diff(self.c) != 0) | (np.diff(self.t) >= idle_us) | marks["rst"][:-1]
        self.break_after = _upcoming(breaks[1:])
        self.rst = marks["rst"]
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.totals = {m: total(marks[m]) for m in ("ack", "rst", "fin")}
        self.next, self.before = {}, {}
        for s in SIDES:
            self.totals |= {f"{s}_packets": total(side[s]), f"{s}_bytes": total(np.where(side[s], octets, 0))}
            self.totals |= {f"{s}_{m}": total(side[s] & marks[m]) for m in ("syn", "syn_ack")}
            self.next |= {f"{s}_{m}": _upcoming(side[s] & marks[m]) for m in ("fin", "syn", "syn_ack", "ack")}
            self.next[s], self.before[s] = _upcoming(side[s]), _latest(side[s])


class FlowAssembler(Replay):
    """Open flows of a bucket's conversations, closed by RST, FIN both ways, or time.

    All conversations of the bucket advance together, one flow of each per round, by places and
    running totals in sorted arrays; no packet is looked at by itself.
    """

    def __init__(self, idle_us: int, active_us: int):
        super().__init__("ts_us")
        self.idle_us, self.active_us = idle_us, active_us

    def advance(self, released, kept, until_us):
        keys = pd.concat([f[CONVERSATION] for f in (kept, released) if f is not None and len(f)], ignore_index=True) if kept is not None or len(released) else None
        if keys is None:
            return None, None, None
        number = keys.groupby(CONVERSATION, sort=False, dropna=False).ngroup().to_numpy()
        held = 0 if kept is None else len(kept)
        count = int(number.max()) + 1
        names = keys.iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        flow = {c: np.zeros(count, np.int64) for c in OPEN}
        present = np.zeros(count, bool)
        if held:
            present[number[:held]] = True
            for c in OPEN:
                flow[c][number[:held]] = kept[c].to_numpy(np.int64)
        done = []

        def close(which):
            if len(which):
                done.append((which, {c: x[which] for c, x in flow.items()}))
                present[which] = False

        if len(released):
            p = _Packets(released, number[held:], self.idle_us)
            at = np.searchsorted(p.c, np.arange(count), side="left")
            end = np.searchsorted(p.c, np.arange(count), side="right")
            while len(now := np.flatnonzero(at < end)):
                self._round(p, flow, present, now, at, end, close)
        due = np.minimum(flow["last"] + self.idle_us, flow["start"] + self.active_us)
        close(np.flatnonzero(present & (due <= until_us)))
        stays = np.flatnonzero(present)
        left = names.iloc[stays].reset_index(drop=True).assign(**{c: flow[c][stays] for c in OPEN}) if len(stays) else None
        rows = pd.concat([self._rows(names.iloc[w].reset_index(drop=True), f) for w, f in done], ignore_index=True) if done else None
        return rows, left, int(due[stays].min()) if len(stays) else None

    def _round(self, p: _Packets, flow: dict, present: np.ndarray, now: np.ndarray, at: np.ndarray, end: np.ndarray, close) -> None:
        """One flow, or the rest of one, of each conversation in ``now``."""
        begin, t = at[now], p.t
        over = present[now] & ((t[begin] - flow["last"][now] >= self.idle_us) | (t[begin] - flow["start"][now] >= self.active_us))
        close(now[over])
        new = ~present[now]
        fresh = now[new]
        for c in OPEN:
            flow[c][fresh] = 0
        for c in ("syn_us", "done_us"):
            flow[c][fresh] = NONE
        flow["start"][fresh], flow["first_lo"][fresh] = t[begin[new]], p.lo[begin[new]]
        present[fresh] = True
        finish = lambda s: np.where(flow[f"fin_{s}"][now] > 0, -1, p.next[f"{s}_fin"][begin])
        closing = np.maximum(finish("lo"), finish("hi")) + 1
        expiry = _first_at_least(t, begin, end[now], flow["start"][now] + self.active_us)
        stop = np.minimum(np.minimum(p.break_after[begin] + 1, closing), expiry)
        flow["last"][now] = t[stop - 1]
        self._shake(p, flow, now, begin, stop)
        for c, total in p.totals.items():
            if c in ("ack", "rst", "fin") or not c.endswith("_packets"):
                flow[c][now] += total[stop] - total[begin]
        for s in SIDES:
            some = p.next[s][begin] < stop
            first = some & (flow[f"{s}_packets"][now] == 0)
            flow[f"{s}_first"][now[first]] = t[p.next[s][begin[first]]]
            flow[f"{s}_last"][now[some]] = t[p.before[s][stop[some] - 1]]
            flow[f"{s}_packets"][now] += p.totals[f"{s}_packets"][stop] - p.totals[f"{s}_packets"][begin]
            flow[f"fin_{s}"][now] |= p.next[f"{s}_fin"][begin] < stop
        close(now[p.rst[stop - 1] | ((flow["fin_lo"][now] > 0) & (flow["fin_hi"][now] > 0))])
        at[now] = stop

    def _shake(self, p: _Packets, flow: dict, now: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        """The first forward ACK after a forward SYN and a backward SYN-ACK completes the handshake."""
        low = flow["first_lo"][now] > 0
        near = lambda m: np.where(low, p.next[f"lo_{m}"][begin], p.next[f"hi_{m}"][begin])
        far = lambda m: np.where(low, p.next[f"hi_{m}"][begin], p.next[f"lo_{m}"][begin])
        asked, answered = flow["syn_us"][now] != NONE, flow["answered"][now] > 0
        syn, syn_ack = np.where(asked, -1, near("syn")), np.where(answered, -1, far("syn_ack"))
        opened = np.maximum(syn, syn_ack)
        after = np.minimum(np.maximum(opened + 1, begin), len(p.t))
        ack = np.where(low, p.next["lo_ack"][after], p.next["hi_ack"][after])
        got = (opened < stop) & (ack < stop) & (flow["done_us"][now] == NONE)
        flow["done_us"][now[got]] = p.t[ack[got]]
        first = ~asked & (syn < stop)
        flow["syn_us"][now[first]] = p.t[syn[first]]
        flow["answered"][now] |= syn_ack < stop

    def _rows(self, key: pd.DataFrame, flow: dict) -> pd.DataFrame:
        low = flow["first_lo"] > 0
        near = lambda c: np.where(low, flow[f"lo_{c}"], flow[f"hi_{c}"])
        far = lambda c: np.where(low, flow[f"hi_{c}"], flow[f"lo_{c}"])
        span = lambda side: pd.array(side("last") - side("first"), "Int64").copy()
        spans = {"_fwd_span": (near, span(near)), "_bwd_span": (far, span(far))}
        for side, values in spans.values():
            values[side("packets") == 0] = pd.NA
        complete = flow["done_us"] != NONE
        latency = pd.array(np.maximum(flow["done_us"] - flow["syn_us"], 0), "Int64")
        latency[~complete] = pd.NA
        pick = lambda a, b: np.where(low, key[a].to_numpy(), key[b].to_numpy())
        return pd.DataFrame(
            {
                "src_ip": pick("lo_ip", "hi_ip"), "dst_ip": pick("hi_ip", "lo_ip"), "src_port": pick("lo_port", "hi_port").astype(np.int32),
                "dst_port": pick("hi_port", "lo_port").astype(np.int32), "protocol": key["protocol"].to_numpy(), "start_us": flow["start"], "last_us": flow["last"],
                "duration_us": flow["last"] - flow["start"], "fwd_packets": near("packets"), "bwd_packets": far("packets"), "fwd_bytes": near("bytes"),
                "bwd_bytes": far("bytes"), **{n: v for n, (_, v) in spans.items()}, "syn_count": near("syn"), "syn_ack_count": far("syn_ack"),
                "ack_count": flow["ack"], "rst_count": flow["rst"], "fin_count": flow["fin"], "syn_ack_ratio": near("syn") / (flow["ack"] + 1),
                "handshake_complete": complete, "handshake_latency_us": latency, "ended_ts": pd.to_datetime(flow["last"] + self.idle_us, unit="us", utc=True),
            }
        )


def stream_flows(packets: DataFrame, idle_us: int, active_us: int, delay_us: int | None = None, buckets: int | None = None) -> DataFrame:
    """Completed flows of a packet stream, each emitted once when it is final, with the sixteen features.

    Packets may come in any order within ``delay_us`` (the idle timeout unless given) behind the latest
    one.  The output's event time ``ended_ts`` is ``idle_us`` after the last packet: never behind the
    watermark, so further stateful operators can follow.
    """
    use_rocksdb(packets.sparkSession)
    flags, tcp = F.col("tcp_flags"), F.col("protocol") == "tcp"
    syn, ack = tcp & tcp_flag(flags, "SYN"), tcp & tcp_flag(flags, "ACK")
    filled = packets.na.fill({"src_ip": "", "dst_ip": "", "src_port": 0, "dst_port": 0, "length": 0})
    marks = {"syn": syn & ~ack, "syn_ack": syn & ack, "ack": ack & ~syn, "rst": tcp & tcp_flag(flags, "RST"), "fin": tcp & tcp_flag(flags, "FIN")}
    keyed = conversation_key(with_event_time(filled, idle_us if delay_us is None else delay_us)).select(
        bucket(packets.sparkSession, *CONVERSATION, buckets=buckets), *CONVERSATION, "ts", "ts_us", "seq", "from_lo", F.col("length").cast("bigint").alias("bytes"),
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()],
    )
    return with_features(replayed(keyed, FlowAssembler(idle_us, active_us), FLOW_ROW, "ended_ts"))


def stream_flow_windows(flows: DataFrame, width_us: int, idle_us: int) -> DataFrame:
    """Flows of :func:`stream_flows` per tumbling window of their end, behind the assembly.

    A window closes once the watermark is ``idle_us`` past its end: then no flow is open any more whose
    last packet is in it, and every one that was has been emitted.
    """
    grouped = flows.groupBy(F.window("ended_ts", f"{width_us} microseconds", startTime=f"{idle_us % width_us} microseconds")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum(F.col("fwd_packets") + F.col("bwd_packets")).alias("packets"), F.max("last_us").alias("latest_us")
    )
    return grouped.select(F.floor((F.unix_micros("window.start") - idle_us) / width_us).alias("window"), "flows", "packets", "latest_us")


def stream_windows(flows: DataFrame, width_us: int, delay_us: int) -> DataFrame:
    """Flows per tumbling window of their end, from a stream of finished flow tables."""
    timed = flows.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", f"{delay_us} microseconds")
    grouped = timed.groupBy(F.window("ts", f"{width_us} microseconds")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum(F.col("fwd_packets") + F.col("bwd_packets")).alias("packets"), F.max("last_us").alias("latest_us")
    )
    index = F.floor(F.unix_micros("window.start") / width_us)
    return grouped.select(index.alias("window"), "flows", "packets", "latest_us")
