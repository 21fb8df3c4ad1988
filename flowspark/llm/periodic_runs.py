"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, as long as ``least`` words and
``copies`` periods, that no neighbouring word extends.  Every word of a run therefore occurs at
least ``copies`` times in it: a word that occurs less often in a segment cannot be in a run of that
segment and splits it, and what is left is counted again, until nothing splits any more.

The lag scan of the segments left goes by octaves.  For lags in (w / 2, w], windows of w words get
exact names (pairs of the names before); a position's lag is the distance to the next equal window
of its segment.  A window at least as long as a run's period recurs inside the run at that period
and no sooner, so consecutive positions of one lag are a run's start to its end, whole: the scan
costs a sort of the words left per octave, whatever the length of the text.

Defined cases: null and empty texts, and texts of white space, have no words and no runs; repeated
rows stand side by side, each with its own result; extra columns are left out; an empty table gives
an empty result.  doc_id is passed through as it is, null or not.
"""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowspark.llm.bytetext import chunks, text_bytes

#: Bytes of text that are scanned at once; a longer text is scanned alone.
PIECE = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _segments(words: np.ndarray, text: np.ndarray, least: int, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words left, and their segments in ascending order."""
    at, segment, span = np.arange(len(words)), text, int(words.max(initial=0)) + 1
    while len(at):
        keep = np.bincount(segment)[segment] >= least
        at, segment = at[keep], segment[keep]
        _, own, count = np.unique(segment * span + words[at], return_inverse=True, return_counts=True)
        keep = count[own] >= copies
        if keep.all():
            break
        at, segment = at[keep], segment[keep]
        if len(at):
            segment = np.concatenate([[0], np.cumsum((np.diff(at) > 1) | (np.diff(segment) > 0))])
    return at, segment


def runs_of(words: np.ndarray, text: np.ndarray, *, least: int, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``position, length, period`` of the runs of numbered words; ``text`` is each word's text, ascending."""
    at, segment = _segments(words, text, least, copies)
    name, width, found = words[at], 1, []
    while len(at):
        long = np.bincount(segment)[segment] >= copies * (width // 2 + 1)
        at, segment, name = at[long], segment[long], name[long]
        count = len(at) - width + 1
        if count <= 0:
            break
        whole = np.flatnonzero(segment[:count] == segment[width - 1 :])
        order = whole[np.argsort(name[whole], kind="stable")]
        same = (name[order[1:]] == name[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag <= width // 2) | (lag > width)] = 0
        new = np.ones(len(at), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at))) - 1 + lag[first] + width
        good = (lag[first] > 0) & (length >= np.maximum(least, copies * lag[first]))
        found.append((at[first[good]], length[good], lag[first[good]]))
        pairs = np.full(len(at), -1, np.int64)
        both = whole[whole + width < len(at)]
        both = both[name[both + width] >= 0]
        if len(both):
            pairs[both] = np.unique(name[both] * (int(name.max()) + 1) + name[both + width], return_inverse=True)[1]
        name, width = pairs, 2 * width
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found)) if found else (empty, empty, empty)


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run after its first period, joined by blanks."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return " ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def periodic_runs(docs: DataFrame, *, least: int = 24, copies: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of each row of ``docs(doc_id, text)``.

    ``runs`` are in order of start, then period, counted in words from 0; ``best`` has the greatest
    exact length / period (ties: smallest start, then period), null without runs; ``collapsed`` keeps
    the first period of each run.  ``copies`` is 3 or more.
    """
    if copies < 3:
        raise ValueError("windows of a period recur inside a run only from three periods on")

    def run(batches):
        for batch in batches:
            _, starts = text_bytes(batch.column("text"))
            for a, b in chunks(starts, PIECE):
                rows = [_WORD.findall(t) if t else [] for t in batch.column("text").slice(a, b - a).to_pylist()]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                numbers = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
                at, length, period = runs_of(numbers, np.repeat(np.arange(len(rows)), sizes), least=least, copies=copies)
                first = np.cumsum(sizes) - sizes
                owner = np.searchsorted(first, at, side="right") - 1
                runs = [[] for _ in rows]
                for o, *r in zip(owner.tolist(), (at - first[owner]).tolist(), length.tolist(), period.tolist()):
                    runs[o].append(tuple(r))
                for r in runs:
                    r.sort(key=lambda x: (x[0], x[2]))
                best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in runs]
                named = lambda x: x and dict(zip(("start", "length", "period"), x))
                columns = [
                    batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array([[named(x) for x in r] for r in runs], pa.list_(_ARROW_RUN)),
                    pa.array([named(x) for x in best], _ARROW_RUN), pa.array([_collapsed(w, r) for w, r in zip(rows, runs)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "best", "collapsed"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, out)
