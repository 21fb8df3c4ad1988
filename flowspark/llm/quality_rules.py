"""Quality rules with certified cutoffs (native: DataFrame functions only).

Every document gets ratios of junk (symbols, repeated lines, repeated words, capitals, marks).
Labelled documents are the holdout: for each stratum (language) and rule, cutoffs of a fixed grid
are tested from lenient to strict.  A cutoff is certified while the exact binomial probability of
seeing so few rejected good documents, were the true false-rejection rate at the limit, stays
below the level; testing stops at the first failure (fixed-sequence testing), and the level is
divided by the number of (stratum, rule) sequences, so that all certified cutoffs hold together
with the stated confidence.  Among certified cutoffs the one with the greatest gain is taken
(labelled junk rejected, less ``good_cost`` for each good document), the most lenient of equals;
with none certified, or no gain, the rule is off for that stratum.

Defined cases: null text has no words and fails the base rule; null language is a stratum of its
own (``''``); labels that are null or contradict each other count as separate observations or not
at all (null); a repeated row gets a row each time; empty tables give empty results; without
labels only the base rule rejects.  Columns beyond ``doc_id, text, lang`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import at, maybe_broadcast, space_words, starts

RULES = ["symbol_ratio", "duplicate_line_ratio", "repeated_word_ratio", "capital_ratio", "exclamation_ratio"]
#: Tested in this order, lenient to strict.
CUTOFFS = [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


def _count(text: Column, chars: str) -> Column:
    return (F.size(F.split(text, chars)) - 1).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """One row per input row: counts, base verdict and the rules' ratios; one pass, no shuffle.

    Write the result before filtering it: a filter that is pushed into these expressions would
    compute them again for every word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("_t"), space_words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        "doc_id", "text_hash", "stratum", "_w", F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), r"[#*$%&|<>]").alias("n_symbols"), _count(F.col("_t"), "[A-Z]").alias("n_capitals"), _count(F.col("_t"), "!").alias("n_exclamations"), lines.alias("_lines"),
    )
    # Hashes of all 8-word windows, in order; equal hashes mark equal windows of one text.
    window = F.transform(starts(F.col("_n"), WINDOW), lambda i: F.xxhash64(*[at(F.col("_w"), i + k) for k in range(WINDOW)]))
    base = base.select(
        "doc_id", "text_hash", "stratum", F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_exclamations",
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_n") > WINDOW, window).alias("_h"),
    )
    # Only texts with an equal pair sort their windows.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    base = base.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, k: x["h"].eqNullSafe(at(F.col("_s"), k - 1)["h"]) | x["h"].eqNullSafe(at(F.col("_s"), k + 1)["h"]))
    base = base.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # Windows start in order: each covers at most WINDOW words beyond the one before it.
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")), lambda a: a["sum"])
    base = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    return base.select(
        "*", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_ratio"), share("n_dup_lines", "n_lines").alias("duplicate_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeated_word_ratio"), share("n_capitals", "word_chars").alias("capital_ratio"),
        share("n_exclamations", "n_words").alias("exclamation_ratio"),
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """Exact P(at most k of n) at a rate; 1.0 from k >= n * rate on, where no test can pass.

    Terms are summed as logarithms, from the term of zero on by the ratio of neighbours.
    """
    import math

    odds, none = math.log(rate / (1 - rate)), math.log1p(-rate)
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (a["s"] + F.log1p(F.exp(a["t"] + F.log((n - i + 1) / i) + odds - a["s"]))).alias("s"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    first = (n * none).cast("double")
    total = F.aggregate(terms, F.struct(first.alias("t"), first.alias("s")), step, lambda a: F.exp(a["s"]))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, *, limit: float = 0.05, confidence: float = 0.95, good_cost: float = 20.0) -> DataFrame:
    """``stratum, rule, cutoff`` of the rules that are on: ``limit`` is the largest share of good
    documents that all rules of a stratum together may reject."""
    marked = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("_good"))
    held = measured.where("NOT base_failed").join(marked, "doc_id")
    level = lambda rule: sum(((F.col(rule) > c).cast("int") for c in CUTOFFS), F.lit(0))  # noqa: E731  cutoffs that reject, all lenient ones last
    cells = held.select("stratum", "_good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("_level")) for r in RULES])).alias("x"))
    cells = cells.groupBy("stratum", "x.rule", "x._level").agg(F.sum("_good").alias("_good"), F.sum(1 - F.col("_good")).alias("_bad"))
    # One row per stratum, rule and cutoff: rejected by cutoff j are the rows whose level is above j strict ones.
    sizes = cells.groupBy("stratum", "rule").agg(F.sum("_good").alias("n_good"), F.collect_list(F.struct("_level", "_good", "_bad")).alias("_cells"))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("cutoff")) for i, c in enumerate(CUTOFFS)])
    rejected = lambda part: F.aggregate("_cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["_level"] >= len(CUTOFFS) - F.col("i"), x[part]).otherwise(0))
    tests = sizes.select("*", F.inline(grid)).select("stratum", "rule", "i", "cutoff", "n_good", rejected("_good").alias("good_rejected"), rejected("_bad").alias("bad_rejected"))
    sequences = sizes.agg(F.greatest(F.count("*"), F.lit(1)).alias("_sequences"))
    p = binomial_tail(F.col("good_rejected"), F.col("n_good"), limit / len(RULES))
    tests = tests.withColumn("p_value", p).crossJoin(F.broadcast(sequences))  # one row
    order = Window.partitionBy("stratum", "rule").orderBy("i")
    tests = tests.withColumn("certified", F.min((F.col("p_value") <= (1 - confidence) / F.col("_sequences"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tests = tests.withColumn("gain", F.col("bad_rejected") - good_cost * F.col("good_rejected"))
    best = tests.where("certified AND gain > 0").groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "p_value", "n_good", "good_rejected", "bad_rejected"), F.struct("gain", "cutoff")).alias("best"))
    return best.select("stratum", "rule", "best.*")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``kept`` and ``failed_rules`` (names, in order of RULES)."""
    wide = cutoffs.groupBy("stratum").pivot("rule", RULES).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    joined = measured.join(maybe_broadcast(wide, 10_000), F.col("stratum") == F.col("_stratum"), "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    joined = joined.withColumn("failed_rules", failed).drop("_stratum", *[f"_{r}" for r in RULES])
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
