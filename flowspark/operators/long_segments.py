"""Greedy flow cuts of a segment too long for one task.

The start that follows packet i depends only on the packets within the active timeout
after i, so it can be computed for every packet in parallel.  The true starts are what
is reachable from the segment's first packet along those links.  Slices of bounded size
resolve their links locally; only packets near the head of a slice can be entered from
an earlier one, and the entries of all slices are found by pointer doubling over them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.ordered import ordered
from flowspark.session import checkpointed


def _links(rows: DataFrame, segment: list[str], active_us: int, limit: int) -> DataFrame:
    """Every packet of the segments with ``pos`` and ``next_pos``, the start after it.

    Time buckets of one active timeout or more: each packet looks into its own bucket
    and the next, and the packet that opens the first later bucket.
    """
    base = ordered(rows, segment, ["ts_us", "seq"], limit)
    base = base.running(pos=("sum", F.lit(1).cast("bigint")))
    numbered = checkpointed(base.done().withColumn("pos", F.col("pos") - 1))
    # Reverse scans for the next FIN of either side: running minimum over descending position.
    back = numbered.select(*segment, "pos", "ts_us", "_fin", "from_lo", (-F.col("pos")).alias("_rev"))
    scan = ordered(back, segment, ["_rev"], limit).running(
        _fin_lo=("min", F.when(F.col("_fin") & F.col("from_lo"), F.col("pos"))),
        _fin_hi=("min", F.when(F.col("_fin") & ~F.col("from_lo"), F.col("pos"))),
    )
    fins = scan.done().select(*segment, "pos", "ts_us", (F.greatest("_fin_lo", "_fin_hi")).alias("_both"), "_fin_lo", "_fin_hi")
    both = F.when(F.col("_fin_lo").isNotNull() & F.col("_fin_hi").isNotNull(), F.col("_both") + 1)
    # First packet at or after ts + active: probes and packets in one descending order.
    probes = fins.select(
        *segment, "pos", both.alias("_close"), (-(F.col("ts_us") + active_us)).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("bigint").alias("_at"),
    )
    marks = fins.select(
        *segment, "pos", F.lit(None).cast("bigint").alias("_close"), (-F.col("ts_us")).alias("_t"), F.lit(0).alias("_kind"),
        F.col("pos").alias("_at"),
    )
    merged = probes.unionByName(marks).withColumn("_rev", -F.col("pos"))
    seen = ordered(merged, segment, ["_t", "_kind", "_rev"], limit).running(_expire=("min", "_at")).done()
    links = seen.where("_kind = 1").select(*segment, "pos", F.least("_close", "_expire").alias("next_pos"))
    return checkpointed(numbered.join(links, [*segment, "pos"]))


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Within one slice: the first position outside it that each packet leads to."""
    frame = frame.sort_values("pos", kind="stable")
    pos, nxt = frame["pos"].to_numpy(), frame["next_pos"].to_numpy()
    first, n = pos[0], len(pos)
    leave = nxt.copy()
    for i in range(n - 1, -1, -1):
        target = nxt[i] - first
        if 0 <= target < n:
            leave[i] = leave[target]
    return frame.assign(leave=leave)


def _starts(frame: pd.DataFrame) -> pd.DataFrame:
    """Within one slice: the packets reached from its entry."""
    frame = frame.sort_values("pos", kind="stable")
    pos, nxt = frame["pos"].to_numpy(), frame["next_pos"].to_numpy()
    first, n = pos[0], len(pos)
    entry = frame["_entry"].to_numpy()[0]
    hit = np.zeros(n, dtype=bool)
    i = -1 if pd.isna(entry) else int(entry - first)
    while 0 <= i < n:
        hit[i] = True
        i = int(nxt[i] - first)
    return frame.drop(columns="_entry").assign(_start=hit)


def cut_long_segments(rows: DataFrame, segment: list[str], active_us: int, limit: int) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("_fin", "pos")]
    linked = _links(rows.withColumnRenamed("pos", "_conversation_pos"), segment, active_us, limit)
    end = F.lit(2**62)
    narrow = linked.select(
        *segment, "pos", F.coalesce("next_pos", end).alias("next_pos"), F.floor(F.col("pos") / limit).cast("bigint").alias("_part")
    )
    group = [*segment, "_part"]
    schema = T.StructType([*narrow.schema.fields, T.StructField("leave", T.LongType())])
    exits = checkpointed(narrow.groupBy(*group).applyInPandas(_exits, schema).select(*segment, "pos", "leave"))
    # Pointer doubling: known entries grow along `leave`, which doubles in reach each round.
    last = exits.agg(F.max("pos")).first()[0]
    rounds = math.ceil(math.log2(last // limit + 2)) + 1
    hop = exits.where("leave < pow(2, 61)")
    entries = exits.where("pos = 0").select(*segment, "pos")
    for _ in range(rounds):
        reached = entries.join(hop, [*segment, "pos"]).select(*segment, F.col("leave").alias("pos"))
        entries = checkpointed(entries.unionByName(reached).distinct())
        ahead = hop.select(*segment, F.col("pos").alias("leave"), F.col("leave").alias("_farther"))
        hop = checkpointed(hop.join(ahead, [*segment, "leave"]).select(*segment, "pos", F.col("_farther").alias("leave")))
    heads = entries.groupBy(*segment, F.floor(F.col("pos") / limit).cast("bigint").alias("_part")).agg(F.min("pos").alias("_entry"))
    entered = narrow.join(heads, group, "left")
    found = T.StructType([f for f in entered.schema if f.name != "_entry"] + [T.StructField("_start", T.BooleanType())])
    starts = entered.groupBy(*group).applyInPandas(_starts, found).where("_start").select(*segment, "pos", "_start")
    flagged = linked.join(starts, [*segment, "pos"], "left")
    parts = ordered(flagged, segment, ["pos"], limit).running(part=("sum", F.coalesce("_start", F.lit(False)).cast("bigint")))
    out = parts.done().withColumn("part", F.col("part") - 1).drop("pos")
    return out.withColumnRenamed("_conversation_pos", "pos").select(*columns, "pos", "part")
