"""Exact repeats of a fixed length, by prefix-free parsing.

Every string of ``length`` bytes has a trigger: the last of the smallest hashes of its ``gram``-byte
substrings, which depends on its content only.  Consecutive positions with one trigger form a phrase
(its bytes reach ``length - 1`` past its last position), so equal text is cut alike wherever it stands,
up to the edges of the equal part.  The parse is the sequence of phrases, the dictionary the
distinct ones.  Two equal strings have equal triggers, so the order of all suffixes, as far as
their first ``length`` bytes go, is found trigger by trigger:

* parse: phrases are dealt by trigger and sorted by (trigger, name of their bytes, corpus order);
  of equal phrases the first stays and each other one is a repeat as a whole;
* dictionary: where one trigger has different phrases (edges of repeats), the first standing of
  each is sorted by its suffixes, cut at ``length`` bytes, and the first of each suffix stays.

Only equality of these suffixes matters, so they are sorted by 128-bit names instead of bytes.

Equal phrases of one task are reduced to the first before they are dealt, so a phrase in a third
of all documents is a row per task, not per document.  Tasks stream sorted rows and hold one
trigger's edges; a trigger with more than ``MOST_EDGES`` of them goes another way: its suffixes
become rows, aggregated by name.  Texts travel compressed.

Corpus order: doc_id ascending, null first, then start.  Defined cases: null text is empty;
rows that repeat a doc_id with another text are ordered by the text's hash; exact repeats of a
(doc_id, text) row give one row; texts shorter than ``length`` lose nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.bytetext import chunks, gram_hashes, sliding_min, span_hashes, text_bytes
from flowspark.llm.common import materialized

#: Bytes hashed at once; longer texts are cut with an overlap of one string.
PIECE = 1 << 18
#: Phrases that a task gathers before it reduces equal ones.
FLUSH = 1 << 20
MOST_EDGES = 20_000
_SECOND = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A span is its first position and its number of strings in one long, so that spans sort by position.
_BITS = 31
SPAN = "d long, tag long, span long"
_PHRASE = ["g", "x", "d", "tag", "span"]


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _merged(d: np.ndarray, tag: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one text that touch or overlap become one."""
    order = np.lexsort((s, tag, d))
    d, tag, s, e = d[order], tag[order], s[order], (s + n)[order]
    if not len(d):
        return d, tag, s
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return d[first], tag[first], s[first] << _BITS | (np.maximum.reduceat(e, first) - s[first])


def phrases_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``row, position, count, trigger``: phrases of texts that stand one after the other in ``data``."""
    hashes = gram_hashes(data, gram)
    triggers = sliding_min(hashes, length - gram + 1)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(triggers)]
    place = np.arange(len(triggers))
    inside = place + length <= starts[rows + 1]
    # Each standing of a trigger is its own: a smaller one left, or one as small came in at the end.
    change = (triggers[1:] != triggers[:-1]) | (hashes[length - gram + 1 :] == triggers[1:])
    new = inside.copy()
    new[1:] &= change | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= change | ~inside[1:]
    begin, end = np.flatnonzero(new), np.flatnonzero(last)
    return rows[begin], begin, end - begin + 1, triggers[begin]


def _phrases(batch: pa.RecordBatch, length: int, gram: int):
    """Columns of ``_PHRASE`` for the texts of a batch, piece by piece."""
    data, starts = text_bytes(batch.column("text"))
    ids, tags = batch.column("d").to_numpy(), batch.column("tag").to_numpy()
    name = xxhash.xxh3_64_intdigest
    for first, end in chunks(starts, PIECE):
        whole = data[starts[first] : starts[end]]
        alone = end == first + 1
        for cut in range(0, max(1, len(whole) - length + 1), PIECE) if alone else (0,):
            piece = np.ascontiguousarray(whole[cut : cut + PIECE + length - 1] if alone else whole)
            bounds = np.array([0, len(piece)]) if alone else starts[first : end + 1] - starts[first]
            row, at, count, trigger = phrases_of(piece, bounds, length, gram)
            view = memoryview(piece)
            names = np.fromiter((name(view[s:e]) for s, e in zip(at.tolist(), (at + count + length - 1).tolist())), np.uint64, len(at))
            yield trigger.view(np.int64), names.view(np.int64), ids[row + first], tags[row + first], (at - bounds[row] + cut) << _BITS | count


def _reduced(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Phrases that are first among equal ones, and the others as merged spans (``x`` null)."""
    g, x, d, tag, span = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((span, tag, d, x, g))
    g, x, d, tag, span = (c[order] for c in (g, x, d, tag, span))
    later = np.concatenate([[False], (g[1:] == g[:-1]) & (x[1:] == x[:-1])])
    rd, rt, rs = _merged(d[later], tag[later], span[later] >> _BITS, span[later] & ((1 << _BITS) - 1))
    names = pa.array(np.concatenate([x[~later], np.zeros(len(rd), np.int64)]), mask=np.concatenate([np.zeros((~later).sum(), bool), np.ones(len(rd), bool)]))
    rest = [np.concatenate([c[~later], r]) for c, r in ((g, rd * 31 + rs), (d, rd), (tag, rt), (span, rs))]
    return pa.RecordBatch.from_arrays([pa.array(rest[0]), names, *map(pa.array, rest[1:])], _PHRASE)


def corpus_phrases(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``g`` trigger, ``x`` name of the phrase's bytes, text and span; null names mark repeats."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in _phrases(batch, length, gram):
                parts.append(part)
                held += len(part[0])
                if held >= FLUSH:
                    yield _reduced(parts)
                    parts, held = [], 0
        if held:
            yield _reduced(parts)

    return docs.mapInArrow(run, "g long, x long, d long, tag long, span long")


def parse_order(phrases: DataFrame) -> DataFrame:
    """``g, d, tag, span, edge``: repeats as a whole (edge false), and the first of each different
    phrase of triggers that have several (edge true)."""

    def run(batches):
        held, told = None, False  # the last first phrase, and whether it was given out as an edge
        for batch in batches:
            null = batch.column("x").is_null().to_numpy(zero_copy_only=False)
            g, x, d, tag, span = (c.fill_null(0).to_numpy() for c in batch.columns)
            yield _batch(["g", "d", "tag", "span", "edge"], [g[null], d[null], tag[null], span[null], np.zeros(null.sum(), bool)])
            rows = [c[~null] for c in (g, x, d, tag, span)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([[h], c]) for h, c in zip(held, rows)]
            g, x, d, tag, span = rows
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            heads = np.flatnonzero(first)
            several = np.zeros(len(heads), bool)
            equal = g[heads][1:] == g[heads][:-1]
            several[1:] |= equal
            several[:-1] |= equal
            given = several.copy()
            if held is not None and told:
                given[0], several[0] = False, True
            held, told = [c[heads[-1]] for c in rows], bool(several[-1])
            pick = np.concatenate([heads[given], np.flatnonzero(~first)])
            edge = np.arange(len(pick)) < given.sum()
            yield _batch(["g", "d", "tag", "span", "edge"], [g[pick], d[pick], tag[pick], span[pick], edge])

    return phrases.repartition("g").sortWithinPartitions(*_PHRASE).mapInArrow(run, f"g long, {SPAN}, edge boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as zstandard frames, for the shuffles."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            frames = [squeeze((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), batch.column("tag"), pa.array(frames, pa.binary())], ["doc_id", "d", "tag", "frame"])

    return docs.mapInArrow(run, "doc_id long, d long, tag long, frame binary")


def _contexts(packed: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``g, d, tag, s, bytes`` of the listed phrases."""
    lists = edges.groupBy("d", "tag").agg(F.collect_list(F.struct("g", "span")).alias("e"))
    texts = packed.join(lists, ["d", "tag"]).select("d", "tag", "frame", F.col("e.g").alias("g"), F.col("e.span").alias("span"))

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, (d, tag, frame) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "tag", "frame")))):
                data = open_(frame)
                g, span = (np.asarray(batch.column(c)[i].values) for c in ("g", "span"))
                s, n = span >> _BITS, span & ((1 << _BITS) - 1)
                parts = [data[a : a + b + length - 1] for a, b in zip(s.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), d)), pa.array(np.full(len(g), tag)), pa.array(s), pa.array(parts, pa.binary())], ["g", "d", "tag", "s", "bytes"])

    return texts.mapInArrow(run, "g long, d long, tag long, s long, bytes binary")


def _suffix_names(column: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """``row, offset, h1, h2`` of every ``length``-byte string of each row."""
    data, starts = text_bytes(column)
    n = np.diff(starts) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + offset
    return row, offset, span_hashes(data, at, at + length).view(np.int64), span_hashes(data, at, at + length, _SECOND).view(np.int64)


def dictionary_order(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated strings among the phrases of each trigger, as spans."""

    def repeats(table: pa.Table):
        g, d, tag, s = (table.column(c).to_numpy() for c in ("g", "d", "tag", "s"))
        row, offset, h1, h2 = _suffix_names(table.column("bytes").combine_chunks() if table.num_rows else pa.array([], pa.binary()), length)
        order = np.lexsort((offset, row, h2, h1, g[row]))  # rows come in corpus order
        row, offset, h1, h2 = row[order], offset[order], h1[order], h2[order]
        later = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (g[row[1:]] == g[row[:-1]])]) if len(row) else np.zeros(0, bool)
        row, offset = row[later], offset[later]
        return _batch(["d", "tag", "span"], list(_merged(d[row], tag[row], s[row] + offset, np.ones(len(row), np.int64))))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            g = table.column("g").to_numpy()
            if not len(g):
                continue
            whole = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0  # the last trigger may go on
            held = table.slice(whole)
            if whole:
                yield repeats(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield repeats(held)

    return contexts.repartition("g").sortWithinPartitions("g", "d", "tag", "s").mapInArrow(run, SPAN)


def hot_dictionary_order(contexts: DataFrame, length: int) -> DataFrame:
    """The same for triggers of any number of phrases: a row per string, aggregated by name."""

    def run(batches):
        for batch in batches:
            d, tag, s = (batch.column(c).to_numpy() for c in ("d", "tag", "s"))
            row, offset, h1, h2 = _suffix_names(batch.column("bytes"), length)
            yield _batch(["h1", "h2", "d", "tag", "s"], [h1, h2, d[row], tag[row], s[row] + offset])

    names = materialized(contexts.mapInArrow(run, "h1 long, h2 long, d long, tag long, s long"), "repeats-suffixes")
    place = F.struct("d", "tag", "s")
    first = names.groupBy("h1", "h2").agg(F.count("*").alias("_c"), F.min(place).alias("_first")).where("_c > 1")
    return names.join(first, ["h1", "h2"]).where(place > F.col("_first")).select("d", "tag", (F.shiftleft("s", _BITS) + 1).alias("span"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for i, frame in enumerate(batch.column("frame").to_pylist()):
                data = open_(frame)
                edges = np.zeros(len(data) + 1, np.int64)
                if batch.column("spans")[i].is_valid:
                    span = np.asarray(batch.column("spans")[i].values)
                    s, n = span >> _BITS, span & ((1 << _BITS) - 1)
                    np.add.at(edges, s, 1)
                    np.add.at(edges, s + n - 1 + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                marks = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
                out.append((len(data), int(gone.sum()), len(marks) // 2, hashlib.sha256(kept).hexdigest(), marks[0::2].tolist(), marks[1::2].tolist()))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], ["doc_id", "tag", *names])

    return texts.mapInArrow(run, "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>")


def remove_repeats(docs: DataFrame, *, length: int = 100, gram: int = 32, most_edges: int = MOST_EDGES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the removed
    runs as ``span_starts`` and ``span_ends`` (byte offsets)."""
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram is a power of two and at most length")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    twice = docs.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    docs = docs.select("doc_id", key.alias("d"), (F.xxhash64("doc_id", "text") if twice else F.lit(0).cast("long")).alias("tag"), "text")
    if twice:  # before phrases are cut: two rows of one (d, tag) would be repeats of each other
        docs = materialized(docs.dropDuplicates(["d", "tag"]), "repeats-once")
    found = materialized(parse_order(corpus_phrases(docs.select("d", "tag", "text"), length, gram)), "repeats-parse")
    edges = found.where("edge").select("g", "d", "tag", "span")
    packed = _packed(docs)
    crowded = materialized(edges.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > most_edges).select("g"), "repeats-crowded")
    gone = found.where("NOT edge").select("d", "tag", "span")
    if crowded.limit(1).count():
        gone = gone.union(hot_dictionary_order(_contexts(packed, edges.join(crowded, "g", "left_semi"), length), length))
        edges = edges.join(crowded, "g", "left_anti")
    gone = gone.union(dictionary_order(_contexts(packed, edges, length), length))
    lists = gone.groupBy("d", "tag").agg(F.collect_list("span").alias("spans"))
    return _cut(packed.join(lists, ["d", "tag"], "left"), length).drop("tag")
