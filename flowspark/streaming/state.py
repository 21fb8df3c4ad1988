"""Sliding rule state per source and the TTL block list, as stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowspark.operators import rules
from flowspark.schemas import FEATURE_COLUMNS
from flowspark.streaming.replay import Replay, bucket, replayed
from flowspark.streaming.source import use_rocksdb, with_event_time

BLOCK_ROW = "ip string, blocked_us bigint, last_hit_us bigint, hits bigint, expires_us bigint"


def _active(source: np.ndarray, start: np.ndarray, stop: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many intervals [start, stop] of its source hold each asked time."""
    who = np.concatenate([source, source, asked])
    when = np.concatenate([start, stop + 1, at])
    change = np.concatenate([np.ones(len(start), np.int64), -np.ones(len(stop), np.int64), np.zeros(len(at), np.int64)])
    order = np.lexsort((np.arange(len(who)) >= 2 * len(source), when, who))  # questions after the changes of their time
    running = np.zeros(len(who), np.int64)
    running[order] = np.cumsum(change[order])  # the changes of a source sum to nothing
    return running[2 * len(source) :]


class SlidingRules(Replay):
    """Distinct ports and half-open flows of each source in [t - window, t], flows in order of their start.

    ``lag_us`` is how far behind the watermark a flow may still start.  Kept are the touches of the last
    window, by (source, port, time); a timer drops the last ones once the watermark has left them behind.
    """

    def __init__(self, window_us: int, ports: int, lag_us: int):
        super().__init__("start_us", lag_us)
        self.window_us, self.ports = window_us, ports

    def advance(self, released, kept, until_us):
        columns = ["src_ip", "dst_port", "start_us", "candidate"]
        out = None
        if len(released):
            out = released.sort_values("start_us", kind="stable").reset_index(drop=True)
            known = out[["src_ip", "dst_port", "start_us"]].assign(candidate=False)
            rows = pd.concat([kept, known], ignore_index=True) if kept is not None else known
            source = pd.factorize(rows["src_ip"], use_na_sentinel=False)[0]
            own = slice(len(rows) - len(out), None)
            t, port = rows["start_us"].to_numpy(np.int64), rows["dst_port"].to_numpy(np.int64)
            out["scan_ports"] = np.where(port[own] > 0, self._ports(source, port, t, own), 0)
            scans = (port[own] > 0) & (out["scan_ports"].to_numpy() >= self.ports)
            rows.loc[rows.index[own], "candidate"] = out["syn_like"].to_numpy(bool) & ~scans
            flood = rows["candidate"].to_numpy(bool)
            counts = _active(source[flood], t[flood], t[flood] + self.window_us, source[own], t[own])
            out["syn_flows"] = np.where(flood[own], counts, 0)
            kept = rows[columns]
        if kept is not None:
            kept = kept[kept["start_us"] > until_us - self.window_us]
        again = int(kept["start_us"].max()) + self.window_us + self.delay_us if kept is not None and len(kept) else None
        return out, kept, again

    def _ports(self, source: np.ndarray, port: np.ndarray, t: np.ndarray, own: slice) -> np.ndarray:
        """Touches of one port no further apart than the window are one interval."""
        touched = np.flatnonzero(port > 0)
        order = touched[np.lexsort((t[touched], port[touched], source[touched]))]
        s, p, when = source[order], port[order], t[order]
        first = np.ones(len(order), bool)
        first[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (np.diff(when) > self.window_us)
        last = np.append(first[1:], True)[: len(order)]
        return _active(s[first], when[first], when[last] + self.window_us, source[own], t[own])


#: What the rules ask of a flow.
RULED = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us", "last_us", "syn_count", *FEATURE_COLUMNS]


def sliding_counts(flows: DataFrame, window_us: int, ports: int, lag_us: int, buckets: int | None = None) -> DataFrame:
    """Adds ``scan_ports`` and ``syn_flows`` to a stream of flows with a watermark and ``syn_like``."""
    use_rocksdb(flows.sparkSession)
    kept = [f for f in flows.schema if f.name not in ("ts", "ended_ts")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", scan_ports bigint, syn_flows bigint"
    return replayed(flows.select("*", bucket(flows.sparkSession, "src_ip", buckets=buckets)), SlidingRules(window_us, ports, lag_us), schema)


def stream_rules(flows: DataFrame, window_us: int, ports: int, active_us: int) -> DataFrame:
    """Rule verdicts of the flows of :func:`flowspark.streaming.flows.stream_flows`, every rule included.

    A flow is judged when the watermark is ``active_us`` past its start: every flow that started no
    later is known by then, so the verdicts are those of the batch rules.
    """
    asked = flows.select(*RULED, "ended_ts", rules.syn_like().alias("syn_like"))
    counted = sliding_counts(asked, window_us, ports, active_us).drop("syn_like")
    return rules.rule_verdicts(rules.flag_syn_flood(rules.flag_port_scan(counted, ports)), window_us)


def stream_port_scan(flows: DataFrame, window_us: int, ports: int, delay_us: int = 0) -> DataFrame:
    """Port-scan verdicts on a stream of finished flows that start in order within ``delay_us``."""
    timed = with_event_time(flows.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_us"), delay_us, "start_us")
    counted = sliding_counts(timed.withColumn("syn_like", F.lit(False)), window_us, ports, 0)
    return rules.flag_port_scan(counted, ports).drop("syn_like", "syn_flows")


class BlockList(StatefulProcessor):
    """One open block per address; hits refresh it, an unblock or its expiry closes it."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "blocked bigint, last bigint, hits bigint")

    def close(self) -> None:
        pass

    def _closed(self, ip: str, block: tuple, at: int | None = None) -> dict:
        expires = block[1] + self.ttl_us
        return dict(ip=ip, blocked_us=block[0], last_hit_us=block[1], hits=block[2], expires_us=expires if at is None else min(at, expires))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "hit"], kind="stable")
        block = self.block.get() if self.block.exists() else None
        if block is not None:
            self.handle.deleteTimer(-(-(block[1] + self.ttl_us) // 1000))
        done = []
        for ts, hit in zip(frame["ts_us"].tolist(), frame["hit"].tolist()):
            if block is not None and ts >= block[1] + self.ttl_us:
                done.append(self._closed(key[0], block))
                block = None
            if hit:
                block = (ts, ts, 1) if block is None else (block[0], ts, block[2] + 1)
            elif block is not None:
                done.append(self._closed(key[0], block, ts))
                block = None
        if block is None:
            self.block.clear()
        else:
            self.block.update(block)
            self.handle.registerTimer(-(-(block[1] + self.ttl_us) // 1000))
        if done:
            yield pd.DataFrame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.block.exists():
            block = self.block.get()
            self.block.clear()
            yield pd.DataFrame([self._closed(key[0], block)])


def stream_blocks(events: DataFrame, ttl_us: int, delay_us: int = 0) -> DataFrame:
    """Block intervals of a stream of (ip, ts_us, hit); ``hit`` false is a manual unblock."""
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", f"{delay_us} microseconds")
    return timed.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=BlockList(ttl_us), outputStructType=BLOCK_ROW, outputMode="Append", timeMode="EventTime"
    )
