"""Language-model scores: prediction by partial matching over bytes, and a word-count base.

The model is a trie of byte contexts up to ``order`` bytes, counted over all training texts.  A
symbol seen after the longest known context has probability c / (n + d) (n symbols, d different
ones; escape estimate d / (n + d)); else the escape is charged and the context shortened by a byte,
where symbols of the longer context are excluded from n and d, since they would not have escaped.
After the empty context the bytes never seen share what is left.  Texts start behind a mark that no
UTF-8 text holds and end with another, so a text's probability includes its end.

Tasks count their own texts' contexts and one row per different context and task is shuffled.  A
trie whose counted size is within ``TRIE_ROWS`` is sent to the workers once; a larger one stays a
table and the documents' contexts are joined with it, level by level, to the same scores.

Word base: add-one estimate of each word.  Frequent words (at most ``HEAD_WORDS``) are summed by
workers in one pass over the texts, so hot words are never shuffled; the words left are joined.

Defined cases: null text is empty: one end token and the end mark; a null doc_id counts as the
empty text for the fold; exact repeats of a (doc_id, text) row are read once; without training
texts every symbol has probability 1 / 256 and N = V = 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.bytetext import chunks, mix, text_bytes
from flowspark.llm.common import materialized

ORDER = 4
BEGIN, END = 0xFE, 0xFF
#: Largest trie, in rows, that workers hold (about 30 bytes a row).
TRIE_ROWS = 4_000_000
#: Frequent words that workers hold, and the longest such word; words a task counts before it hands on.
HEAD_WORDS, HEAD_BYTES, HELD_WORDS = 200_000, 64, 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 19


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its ``order`` bytes before it, packed (symbol lowest), and its row."""
    rows = len(starts) - 1
    sizes = np.diff(starts) + order + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.full(begins[-1], BEGIN, np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    inside = np.arange(begins[-1]) - begins[owner]
    body = (inside >= order) & (inside < sizes[owner] - 1)
    padded[body] = data
    padded[begins[1:] - 1] = END
    packed = padded[order:].copy()
    for back in range(1, order + 1):
        packed |= padded[order - back : len(padded) - back] << np.uint64(8 * back)
    keep = inside[order:] >= order
    return packed[keep], owner[order:][keep]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """``gram, c`` over all texts."""

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            for a, b in chunks(starts, 4 << 20):
                found, n = np.unique(grams(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], order)[0], return_counts=True)
                keys.append(found)
                counts.append(n)
                held += len(found)
                if held > 4_000_000:
                    k, c = _summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > 3_000_000:  # hand on, the shuffle sums again
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["gram", "c"])
                        keys, counts, held = [], [], 0
        if keys:
            k, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["gram", "c"])

    return texts.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class Trie:
    """The trie in arrays: for each level sorted grams and contexts with n, d and the mass x that
    their symbols have one level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        order_ = np.argsort(keys)
        keys, counts = keys[order_].astype(np.uint64), counts[order_].astype(np.int64)
        for k in range(order, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys, counts = _summed([keys & mask], [counts])
            first = np.flatnonzero(np.concatenate([[True], keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)])) if len(keys) else np.zeros(0, np.int64)
            n = np.add.reduceat(counts, first) if len(first) else counts
            d = np.diff(np.concatenate([first, [len(keys)]]))
            self.levels.append({"keys": keys, "c": counts, "ctx": keys[first] >> np.uint64(8), "n": n, "d": d, "first": first})
        for k, upper, lower in zip(range(order - 1, -1, -1), self.levels, self.levels[1:]):
            below = lower["c"][np.searchsorted(lower["keys"], upper["keys"] & np.uint64((1 << 8 * (k + 1)) - 1))] if len(upper["keys"]) else upper["c"]
            upper["x"] = np.add.reduceat(below, upper["first"]) if len(upper["first"]) else below
        top = self.levels[0]
        group = np.repeat(np.arange(len(top["ctx"])), top["d"])
        self._build(top["keys"], np.log10(top["c"] / (top["n"] + top["d"])[group]) if len(group) else np.zeros(0))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open-addressing table of the longest contexts' symbols."""
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))  # no gram: grams have 8 * (order + 1) bits
        self.values = np.zeros(1 << bits)
        left, at = np.arange(len(keys)), mix(keys.copy()) * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        while len(left):
            free = self.slots[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.slots[at[free]] = keys[left[free]]
            won = self.slots[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], at[~won] + np.uint64(1) & self.mask

    def logs(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of each packed symbol after its context."""
        out = np.empty(len(g), np.float64)
        at = mix(g.copy()) * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        got = self.slots[at]
        hit = got == g
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit)
        at, got = at[left], got[left]
        missing = []
        while len(left):
            gone = got == np.uint64(0xFFFFFFFFFFFFFFFF)
            missing.append(left[gone])
            left, at = left[~gone], at[~gone] + np.uint64(1) & self.mask
            got = self.slots[at]
            hit = got == g[left]
            out[left[hit]] = self.values[at[hit]]
            left, at, got = left[~hit], at[~hit], got[~hit]
        if missing and len(rest := np.concatenate(missing)):
            unseen, back = np.unique(g[rest], return_inverse=True)
            out[rest] = self.escaped(unseen)[back]
        return out

    def escaped(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of symbols, by way of all levels."""
        total, done = np.zeros(len(g)), np.zeros(len(g), bool)
        xn, xd = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for level, table in enumerate(self.levels):
            k = self.order - level
            if not len(table["keys"]):
                break
            key = g & np.uint64((1 << 8 * (k + 1)) - 1)
            i = np.minimum(np.searchsorted(table["ctx"], key >> np.uint64(8)), len(table["ctx"]) - 1)
            known = (table["ctx"][i] == key >> np.uint64(8)) & ~done
            j = np.minimum(np.searchsorted(table["keys"], key), len(table["keys"]) - 1)
            seen = (table["keys"][j] == key) & known
            n, d = table["n"][i] - xn, table["d"][i] - xd
            total[seen] += np.log10(table["c"][j[seen]] / (n + d)[seen])
            done |= seen
            miss = known & ~seen
            paid = miss & (d > 0)
            total[paid] += np.log10(d[paid] / (n + d)[paid])
            if k:
                xn[miss], xd[miss] = table["x"][i[miss]], table["d"][i[miss]]
            else:
                total[miss] -= np.log10(256 - table["d"][0])
                done |= miss
        total[~done] -= np.log10(256)
        return total


def score_by_trie(docs: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``doc_id, tag, score`` with the trie in every worker."""
    table = counts.toArrow()
    trie = Trie(table["gram"].to_numpy().view(np.uint64), table["c"].to_numpy(), order)
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            sums = np.zeros(batch.num_rows)
            for a, b in chunks(starts, PIECE):
                g, row = grams(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], order)
                sums[a:b] = np.bincount(row, shared.value.logs(g), minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(sums)], ["doc_id", "tag", "score"])

    return docs.mapInArrow(run, "doc_id long, tag long, score double")


def score_by_tables(docs: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """The same scores with every level of the trie as a table: contexts of the documents are
    counted per document and joined level by level."""

    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                g, n = np.unique(grams(data[starts[i] : starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]), order)[0], return_counts=True)
                one = batch.slice(i, 1)
                ids, tags = (one.column(c).take(pa.array(np.zeros(len(g), np.int64))) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([ids, tags, pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "tag", "gram", "times"])

    levels, table = [], counts
    for k in range(order, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        table = materialized(table.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("c").alias("c")), f"ppm-level{k}")
        levels.append(table)
    used = materialized(docs.mapInArrow(run, "doc_id long, tag long, gram long, times long"), "ppm-used")
    state = used.select(F.col("gram").alias("g")).distinct()
    state = state.select("g", *[F.lit(v).alias(c) for c, v in (("total", 0.0), ("done", False))], *[F.lit(0).cast("long").alias(c) for c in ("xn", "xd")])
    for k, table in zip(range(order, -1, -1), levels):
        key = F.col("g").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        context = table.select(F.shiftrightunsigned("gram", 8).alias("ctx"), "gram", "c")
        if k:
            below = levels[order - k + 1].select(F.col("gram").alias("_g"), F.col("c").alias("_c"))
            context = context.join(below, F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("_g"))
        else:
            context = context.withColumn("_c", F.lit(0).cast("long"))
        context = context.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("_c").alias("x"))
        state = state.join(context, F.shiftrightunsigned(key, 8) == F.col("ctx"), "left").join(table.select(F.col("gram").alias("_s"), "c"), key == F.col("_s"), "left")
        n, d = F.col("n") - F.col("xn"), F.col("d") - F.col("xd")
        live = ~F.col("done") & F.col("ctx").isNotNull()
        seen = live & F.col("c").isNotNull()
        last = F.log10(256 - F.col("d")) if k == 0 else F.lit(0.0)
        step = F.when(seen, F.log10(F.col("c") / (n + d))).when(live, F.when(d > 0, F.log10(d / (n + d))).otherwise(0.0) - last).otherwise(0.0)
        gone = live & ~F.col("c").isNotNull()
        state = state.select("g", (F.col("total") + step).alias("total"), (F.col("done") | seen | (gone if k == 0 else F.lit(False))).alias("done"), F.when(gone, F.col("x")).otherwise(F.col("xn")).alias("xn"), F.when(gone, F.col("d")).otherwise(F.col("xd")).alias("xd"))
        state = materialized(state, "ppm-state")
    values = state.select("g", (F.col("total") - F.when(F.col("done"), 0.0).otherwise(F.log10(F.lit(256.0)))).alias("value"))
    return used.join(values, used["gram"] == values["g"]).groupBy("doc_id", "tag").agg(F.sum(F.col("times") * F.col("value")).alias("score"))


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_d", "tag": "_t"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_d"]) & (left["tag"] == right["_t"]), how).drop("_d", "_t")


def head_threshold(counts: DataFrame) -> int:
    """The smallest count of a power of 2^(1/16) that no more than HEAD_WORDS words reach."""
    level = F.floor(F.log2("c") * 16)
    steps = counts.groupBy(level.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("k")).collect()  # under 1,024 rows
    taken, least = 0, 1 << 62
    for step in steps:
        taken += step.n
        if taken > HEAD_WORDS:
            break
        least = step.least
    return least


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    """Lower-cased words of each text: bytes split at the white space of ASCII, which is the contract's."""
    data, starts = text_bytes(column)
    for a, b in chunks(starts, 4 << 20):
        raw, ends = data[starts[a] : starts[b]].tobytes().translate(_LOWER), (starts[a : b + 1] - starts[a]).tolist()
        for first, end in zip(ends, ends[1:]):
            yield raw[first:end].split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts; a task hands on its counts whenever it holds HELD_WORDS words."""

    def run(batches):
        held = Counter()

        def out():
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

        for batch in batches:
            for words in _words(batch.column("text")):
                held.update(words)
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_scores(docs: DataFrame, head: dict[bytes, float]) -> DataFrame:
    """``doc_id, tag, n_tokens``, the sum and number of the words in ``head``, and the words left."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        known = shared.value.get
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for words in _words(part.column("text")):
                    found = list(map(known, words))
                    rest = [w for w, v in zip(words, found) if v is None] if None in found else []
                    rows.append((len(words) + 1, sum(filter(None, found)), len(words) - len(rest), rest))
                n, total, within, rest = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(within, pa.int64()), pa.array(rest, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), *columns], ["doc_id", "tag", "n_tokens", "_head", "_in_head", "_rest"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, n_tokens long, _head double, _in_head long, _rest array<binary>")


def base_scores(docs: DataFrame, trained: Column) -> DataFrame:
    """``doc_id, tag, n_tokens, n_known, train_tokens, base_score``."""
    counts = materialized(word_counts(docs.where(trained)), "lm-words")
    texts = docs.where(trained).agg(F.count("*")).first()[0]
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)
    logs = counts.select("word", "c", F.log10(F.col("c") + 1.0).alias("_l"))
    short = logs.where(F.octet_length("word") <= HEAD_BYTES)
    head = short.where(F.col("c") >= head_threshold(short)).select("word", "_l").toArrow()  # HEAD_WORDS rows at most
    out = materialized(head_scores(docs, dict(zip(head.column("word").to_pylist(), head.column("_l").to_pylist()))), "lm-documents")
    other = out.select("doc_id", "tag", F.explode("_rest").alias("word")).join(logs.select("word", "_l"), "word")
    other = other.groupBy("doc_id", "tag").agg(F.sum("_l").alias("_tail"), F.count("*").alias("_in_tail"))
    out = _same(out.drop("_rest"), other, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    logs = zero("_head") + zero("_tail") + F.log10(F.lit(texts + 1.0))
    return out.select("doc_id", "tag", "n_tokens", (zero("_in_head") + zero("_in_tail") + int(texts > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"))


def score(docs: DataFrame, trained: Column, *, order: int = ORDER, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """``doc_id, tag, n_tokens, n_known, train_tokens, base_score, score`` for every document; the
    model learns from rows where ``trained`` holds.  ``tag`` tells apart texts of one doc_id."""
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("tag"))
    docs = docs.dropDuplicates(["doc_id", "tag"]) if twice else docs
    counts = materialized(gram_counts(docs.where(trained), order), "ppm-grams")
    scored = score_by_trie if counts.count() <= trie_rows else score_by_tables
    return _same(base_scores(docs, trained), scored(docs, counts, order), "inner")
