"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is cut into segments and mapped to the vector of their bit counts.  Two fingerprints
that differ in at most d bits have vectors within Manhattan distance d, so the vectors are joined
on a unit grid first: both sides visit the grid cells within d / 2 of their vector (one step for
d = 1 or 2), and only fingerprints that meet another one in a cell go on.  These are verified exactly by the
same step on single bits: two 64-bit words differ in at most 2 bits if and only if some word lies
within one bit of both, so sharing such a midpoint is a link, and its lowest fingerprint the
centre of a star.  Rows stay linear in the distinct fingerprints (about 49 cells each, 65
midpoints for candidates) however many copies or neighbours there are; no pair is ever listed.

Defined cases: null or wordless texts have fingerprint zero and link like any other; exact repeats
of a (doc_id, text) row give one row; a null doc_id keeps its row, and its component takes the
smallest id that is not null (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import ascii_lower, at, connected_components, materialized, space_words, starts

BITS = 64


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp``: XXH64 (seed 42) of the shingles, majority of each bit.

    Counts travel two bits to a long (32 bits each), so one partial aggregate per document and
    task is shuffled, not its shingles.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), space_words(ascii_lower(F.col("text"))).alias("_w"))
    cells = words.withColumn("_n", F.size("_w")).select("*", F.explode(starts(F.col("_n"), shingle)).alias("_i"))
    joined = F.concat_ws(" ", *[at(F.col("_w"), F.col("_i") + k) for k in range(shingle)])
    hashed = cells.select("doc_id", "text_hash", F.when(F.col("_n") > 0, F.xxhash64(joined)).alias("_h"))
    pair = lambda j: F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(0x100000001)))
    sums = hashed.groupBy("doc_id", "text_hash").agg(F.count("_h").alias("_n"), *[pair(j).alias(f"_s{j}") for j in range(32)])
    one = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    set_if = lambda count, j: F.when(2 * count > F.col("_n"), one(j)).otherwise(F.lit(0).cast("long"))
    sums = sums.select("doc_id", "text_hash", "_n", F.array(*[F.coalesce(f"_s{j}", F.lit(0).cast("long")) for j in range(32)]).alias("_c"))
    fp = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"),
        lambda a, j: a.bitwiseOR(set_if(F.get("_c", j).bitwiseAND(F.lit(0xFFFFFFFF)), j)).bitwiseOR(set_if(F.shiftrightunsigned(F.get("_c", j), 32), j + 32)),
    )
    return sums.select("doc_id", "text_hash", F.coalesce(fp, F.lit(0).cast("long")).alias("fp"))


def packed_counts(fp: Column, width: int) -> Column:
    """Bit counts of all ``width``-bit segments (2, 4 or 8), each in the place of its segment."""
    masks = {1: 0x5555555555555555, 2: 0x3333333333333333, 4: 0x0F0F0F0F0F0F0F0F}
    half = 1
    while half < width:
        a, b = fp.bitwiseAND(F.lit(masks[half])), F.shiftrightunsigned(fp, half).bitwiseAND(F.lit(masks[half]))
        # Single bits are added without carry into the sign; later sums leave it free.
        fp = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1)) if half == 1 else a + b
        half *= 2
    return fp


def _visits(distinct: DataFrame, segments: int) -> DataFrame:
    """``fp, cell``: grid cells within one step of each popcount vector, its own included.

    A cell is the packed vector; a step adds or takes one in one segment's place, within 0 and the
    segment's width.  Rows are spread first, since few bytes become many.
    """
    width = BITS // segments
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp", packed_counts(F.col("fp"), width).alias("own")).repartition(spread)
    rows = rows.select("fp", "own", F.explode(F.sequence(F.lit(0), F.lit(2 * segments))).alias("i"))
    place = (F.floor(F.col("i") / 2) % segments * width).cast("int")
    count = F.expr("shiftrightunsigned(own, place)").bitwiseAND(F.lit((1 << width) - 1))
    rows = rows.select("fp", "own", "i", place.alias("place")).withColumn("count", count)
    up = F.col("i") % 2 == 0
    allowed = (F.col("i") == 2 * segments) | F.when(up, F.col("count") < width).otherwise(F.col("count") > 0)
    # Xor with what changes: the place's count before and after the step, so that no field can carry.
    after = F.when(up, F.col("count") + 1).otherwise(F.col("count") - 1)
    moved = F.expr("own ^ shiftleft(count ^ after, place)")
    rows = rows.where(allowed).withColumn("after", after)
    return rows.select("fp", F.when(F.col("i") == 2 * segments, F.col("own")).otherwise(moved).alias("cell"))


def candidates(distinct: DataFrame, *, segments: int = 32) -> DataFrame:
    """Fingerprints that share a grid cell with another one: the Manhattan lower bound."""
    visits = _visits(distinct, segments)
    shared = visits.groupBy("cell").agg(F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).where("_lo < _hi").select("cell")
    return visits.join(shared, "cell", "left_semi").select("fp").distinct()


def links(distinct: DataFrame, *, max_distance: int = 2, segments: int = 32) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_distance`` bits."""
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance is 0, 1 or 2")
    if max_distance == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    near = materialized(candidates(distinct, segments=segments), "simhash-near")
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    if max_distance == 1:
        moved = near.select(F.col("fp").alias("a"), F.explode(flips).alias("b"))
        return moved.join(near.select(F.col("fp").alias("b")), "b", "left_semi").where("a > b")
    middles = near.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
    stars = middles.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("_hi")).where("b < _hi").drop("_hi")
    return middles.join(stars, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_distance: int = 2, segments: int = 32) -> DataFrame:
    """``doc_id, text_hash, fp, component_id``: the smallest doc_id reachable over links."""
    prints = materialized(fingerprints(docs, shingle=shingle), "simhash-prints")
    classes = materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), max_distance=max_distance, segments=segments)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(firsts, "root").select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")
