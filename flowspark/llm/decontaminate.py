"""Benchmark decontamination by a prefix-filtered join (native: DataFrame functions only).

Items are cut into windows of ``window`` words (shorter items are one window).  Shingles of a
window are ordered by rarity in the documents; with e allowed changed words at most e * shingle
of them can be missing, so a window that occurs shares at least one of its e * shingle + 1
rarest shingles: only these are joined.  The matching shingle fixes where the window would start;
starts before the text or windows beyond its end are cut off (positional and length bounds), and
what is left is verified word by word.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: null or wordless texts have no words and no hits; items with a null id, null text or
no words are ignored; repeated items count once; exact repeats of a (doc_id, text) row give one
row; a null doc_id is a document like any other; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import ascii_lower, at, is_small, materialized, starts

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item, win``: every window of every item once, as an array of words."""
    words = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("_w"))
    words = words.where(F.size("_w") > 0).withColumn("_i", F.explode(starts(F.size("_w"), window)))
    return words.select("item", F.slice("_w", F.col("_i") + 1, window).alias("win")).distinct()


def _shingle(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[at(words, i + j) for j in range(k)])


def prefixes(windows: DataFrame, frequency: DataFrame, k: int, changed: int) -> DataFrame:
    """``sh, offset, win``: the shingles of each window to join, rarest first."""
    n = F.size("win")
    grams = windows.withColumn("offset", F.explode(starts(n, k))).withColumn("sh", _shingle(F.col("win"), F.col("offset"), k))
    ranked = grams.join(frequency, "sh", "left").withColumn("_rank", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("df", F.lit(0)), "sh", "offset")))
    return ranked.where(F.col("_rank") <= k * changed + 1).select("sh", "offset", "win")


def occurrences(docs: DataFrame, windows: DataFrame, *, shingle: int = 3, changed: int = 0, small: bool | None = None) -> DataFrame:
    """``doc_id, text_hash, n_words, start, win``: a row per window occurrence, and for every
    document a row without one.

    ``windows(win)`` holds distinct windows.  Windows of fewer words than ``shingle`` are joined by
    all their words.  ``small`` chooses between the broadcast form (one pass, verified in place)
    and the shuffled form; by default the windows' shingles are counted to decide.
    """
    if changed and windows.where(F.size("win") < shingle * (changed + 1)).limit(1).count():
        raise ValueError("windows are too short for so many changed words")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("_w"))
    texts = texts.withColumn("n_words", F.size("_w"))
    size = F.least(F.size("win"), F.lit(shingle))
    ks = sorted(r[0] for r in windows.select(size).distinct().collect()) or [shingle]  # at most `shingle` values
    small = is_small(windows.select(F.explode("win"))) if small is None else small
    found = None
    for k in ks:
        own = windows.where(size == k)
        sought = own.select(F.explode(starts(F.size("win"), k)).alias("i"), "win").select(_shingle(F.col("win"), F.col("i"), k).alias("sh")).distinct()
        grams = texts.withColumn("i", F.explode(starts(F.col("n_words"), k))).withColumn("sh", _shingle(F.col("_w"), F.col("i"), k))
        counted = grams.join(F.broadcast(sought) if small else sought, "sh", "left_semi").groupBy("sh").agg(F.count("*").alias("df"))
        wanted = materialized(prefixes(own, counted, k, changed), "decontaminate-prefix")
        begin, length = F.col("i") - F.col("offset"), F.size("win")
        fits = (begin >= 0) & (begin + length <= F.col("n_words"))
        spot = F.slice("_w", F.greatest(begin, F.lit(0)) + 1, F.coalesce(length, F.lit(0)))
        same = (spot == F.col("win")) if not changed else F.size(F.filter(F.zip_with(spot, "win", lambda a, b: a.eqNullSafe(b)), lambda x: x)) >= length - changed
        start = F.when(fits, F.when(same, begin))
        if small:
            hits = grams.join(F.broadcast(wanted), "sh", "left")
        else:
            near = grams.select("doc_id", "text_hash", "i", "sh").join(wanted, "sh").drop("sh")
            near = near.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
            hits = texts.join(near, texts["doc_id"].eqNullSafe(near["_d"]) & (texts["text_hash"] == near["_h"]), "left").drop("_d", "_h")
        hits = hits.withColumn("start", start).where(F.col("start").isNotNull() | F.coalesce(F.col("i") == 0, F.lit(True)))
        part = hits.select("doc_id", "text_hash", "n_words", "start", F.when(F.col("start").isNotNull(), F.col("win")).alias("win"))
        if not small:  # a row without an occurrence for each document, whatever was found
            part = part.union(texts.select("doc_id", "text_hash", "n_words", F.lit(None).cast("int"), F.lit(None).cast("array<string>")))
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 3, changed: int = 0, small: bool | None = None) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated``.

    ``n_hit`` counts words inside any occurrence, ``item_ids`` are sorted as strings.
    """
    pairs = materialized(item_windows(items, window), "decontaminate-windows")
    rows = materialized(occurrences(docs, pairs.select("win").distinct(), shingle=shingle, changed=changed, small=small), "decontaminate-hits")
    key = ["doc_id", "text_hash"]
    hits = rows.where("start IS NOT NULL")
    ends = hits.groupBy(*key, "start").agg(F.max(F.col("start") + F.size("win")).alias("end"))
    earlier = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gained = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    covered = ends.withColumn("_g", gained).groupBy(*key).agg(F.sum("_g").alias("n_hit"))
    named = hits.select(*key, "win").distinct().join(pairs, "win").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = rows.groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"))
    for part in (covered, named):
        part = part.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
        out = out.join(part, out["doc_id"].eqNullSafe(part["_d"]) & (out["text_hash"] == part["_h"]), "left").drop("_d", "_h")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
