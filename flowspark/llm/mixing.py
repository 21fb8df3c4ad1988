"""Mixing sources to target weights: budgets down a domain-language-source tree.

Weights are normalised among siblings and multiplied down the tree.  A node can spend at most what
its leaves hold times ``max_epochs``.  Where a child cannot spend its share, the rest goes to its
siblings in proportion to their weights; only what no sibling can take is offered to the siblings
of the parent, since a parent's own limit is the sum of its children's.  A leaf with budget b takes
b // tokens whole epochs and, of the next epoch's seeded order, the prefix that holds the rest.

Defined cases: null domain, language or source is the node ``''``; null or wordless texts hold no
tokens and are in no prefix (they are kept in whole epochs); weights that are missing count 1, null
or negative ones 0; exact repeats of a (doc_id, text) row count once; an empty table gives an empty
result; budgets above everything available spend everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import materialized, running_total, space_words

LEVELS = ["domain", "lang", "source"]


def leaf_rows(docs: DataFrame, domain: Column) -> DataFrame:
    """``doc_id, text_hash, domain, lang, source, n_tokens``: one row per document."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.size(space_words(F.col("text"))).cast("long").alias("n_tokens")).dropDuplicates(["doc_id", "text_hash"])


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Splits ``given`` of each parent among its children by weight, up to their ``room``.

    Children are ordered by the water level at which they are full (room / weight); those below
    the common level get their room, the others the level times their weight.
    """
    level = F.when(F.col("weight") > 0, F.col("room") / F.col("weight"))
    nodes = nodes.withColumn("_level", level)
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy(F.col("_level").asc_nulls_last(), "node")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    spent = F.coalesce(F.sum("room").over(upto), F.lit(0.0))
    # With all children before this one full, the level that spends the rest.
    nodes = nodes.withColumn("_rise", F.when(F.col("weight") > 0, (F.col("given") - spent) / open_weight))
    nodes = nodes.withColumn("_full", F.coalesce(F.col("_rise") >= F.col("_level"), F.lit(False)))
    water = F.max(F.when(~F.col("_full"), F.col("_rise"))).over(by)
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("room")).otherwise(F.coalesce(water * F.col("weight"), F.lit(0.0)))).drop("_level", "_rise", "_full")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, total: Column, max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, weight, budget`` for every leaf, budget in whole tokens.

    ``weights(level, node, weight)`` names nodes by their path joined with ``/``; ``total`` is a
    column over the summed ``tokens``.
    """
    own = weights.groupBy("level", "node").agg(F.max(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("_w"))
    nodes = leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    for depth, level in enumerate(LEVELS):
        named = own.where(F.col("level") == level).select(F.col("node").alias("_node"), F.col("_w").alias(f"_w_{level}"))
        nodes = nodes.join(named, F.concat_ws("/", *LEVELS[: depth + 1]) == F.col("_node"), "left").drop("_node")
        nodes = nodes.withColumn(f"_w_{level}", F.coalesce(f"_w_{level}", F.lit(1.0)))
    usable = F.least(*[F.col(f"_w_{level}") for level in LEVELS]) > 0
    nodes = nodes.withColumn("room", F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    parents = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(total.cast("double").alias("given"), F.lit(1.0).alias("product"))
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        level_nodes = nodes.groupBy(*path).agg(F.sum("room").alias("room"), F.first(f"_w_{level}").alias("weight")).withColumn("node", F.concat_ws("/", *path))
        level_nodes = level_nodes.join(parents, path[:-1]) if depth else level_nodes.crossJoin(F.broadcast(parents))  # one row
        siblings = Window.partitionBy(*path[:-1]) if depth else Window.partitionBy(F.lit(1))
        part = F.coalesce(F.col("weight") / F.nullif(F.sum("weight").over(siblings), F.lit(0.0)), F.lit(0.0))
        shared = _share(level_nodes.withColumn("product", F.col("product") * part), path[:-1])
        parents = shared.select(*path, F.col("budget").alias("given"), "product")
    whole = F.least(F.floor(F.col("given") + 1e-6), F.col("tokens") * max_epochs).cast("long")
    return nodes.select(*LEVELS, "tokens").join(parents, LEVELS).select(*LEVELS, "tokens", F.col("product").alias("weight"), whole.alias("budget"))


def mix(docs: DataFrame, weights: DataFrame, *, domain: Column, total: Column, max_epochs: int = 2, seed: int = 1) -> DataFrame:
    """``doc_id, text_hash``, leaf, ``n_tokens``, leaf ``budget``, ``epochs`` (whole ones) and
    ``prefix_tokens`` (tokens of the document inside the next epoch's prefix; the document at its
    edge is cut there), with ``before``, the tokens ahead of it in that epoch's order."""
    rows = materialized(leaf_rows(docs, domain), "mix-rows")
    budgets = materialized(leaf_budgets(rows, weights, total, max_epochs), "mix-budgets")
    split = budgets.select(*LEVELS, "budget", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("epochs"), "tokens")
    split = split.withColumn("_rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("tokens")
    rows = rows.join(split, LEVELS)
    draw = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("text_hash"))
    rows = rows.withColumn("_order", (F.shiftrightunsigned(draw, 11).cast("double") / float(1 << 53)))
    rows = running_total(rows, LEVELS, "_order", ["doc_id", "text_hash"], "n_tokens")
    taken = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("_rest") - F.col("before")))
    return rows.select("doc_id", "text_hash", *LEVELS, "n_tokens", "budget", "epochs", taken.cast("long").alias("prefix_tokens"), F.col("before").cast("long"))
