"""The numbered queries over the supplied tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import decontaminate, disclosure, mixing, negatives, periodic_runs, ppm, quality_net, quality_rules, repeats, simhash, token_files, toxicity_fm, url_filter
from flowspark.llm.common import fresh_dir, materialized, space_words, table

#: Fixed rules of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: Id appended to every document.
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), tokenizer=tokenizer_path(), end_id=END_ID)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ppm.fold(F.col("doc_id"), 7) == 2
    out = ppm.score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ppm.fold(F.col("doc_id"), 3) == 1
    out = quality_net.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, at most two epochs of a leaf, to the weights of MIX_WEIGHTS."""
    out = mixing.mix(table(spark, sf_dir, "documents"), mix_weights(spark), domain=mix_domain(), total=F.floor(F.col("tokens") * 9 / 10), max_epochs=2)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "budget", "epochs", "before", "prefix_tokens")


def mix_domain():
    """Domains of the sources: their number modulo four."""
    return F.concat(F.lit("domain"), F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int") % 4)


#: level, node, weight; nodes that are not named weigh 1.
MIX_WEIGHTS = [("domain", "domain0", 3.0), ("domain", "domain1", 2.0), ("lang", "domain0/en", 2.0), ("lang", "domain1/en", 2.0), ("lang", "domain2/en", 3.0), ("source", "domain0/en/src0", 4.0), ("source", "domain1/de/src1", 2.0)]


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "level string, node string, weight double")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialized(quality_rules.measures(table(spark, sf_dir, "documents")), "quality-measures")
    cutoffs = quality_rules.certified_cutoffs(measured, table(spark, sf_dir, "labels"))
    out = quality_rules.judge(measured, cutoffs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = ppm.fold(F.col("doc_id"), 3) == 1
    out = toxicity_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    out = url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict", "class_blocked")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.disclosures(table(spark, sf_dir, "documents"), window=10, support=3, remove=1.0, generalise=2.0)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    spans = joined(F.concat("base", "terms")).alias("spans")
    return out.select("doc_id", *map(count, disclosure.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), spans)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``embeddings``, with the labels of every seventh id moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), least=24, copies=3)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's rewriting: in every tenth document by hash, the words from a on repeat p of them."""
    words, h = F.col("words"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size(words), F.floor(h / 10)
    docs = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, space_words(F.col("text"))).alias("words"))
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.flatten(F.array_repeat(F.slice(words, F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, 1, F.col("a")), repeated), 1, n), " ")
    return docs.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in [op1_token_files, op2_decontaminate, op3_ppm, op4_quality_net, op5_simhash, op6_mix, op7_quality_rules, op8_toxicity_fm, op9_redirects, op10_repeats, op11_disclosure, op12_negatives, op13_periodic_runs]}
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The others need XXH64, a tokenizer, trained models or components; tests hold them against plain Python.
ORACLE: dict[str, str] = {
    "op2_decontaminate": f"""
WITH w AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, array_to_string(list_slice(ws, k, k + 9), ' ') AS win, least(len(ws), 10) AS l FROM s),
p AS (SELECT doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS k FROM w, (SELECT DISTINCT l FROM iw) ls WHERE len(ws) >= l),
dw AS (SELECT doc_id, k, l, array_to_string(list_slice(ws, k, k + l - 1), ' ') AS win FROM p),
h AS (SELECT DISTINCT dw.doc_id, dw.k, dw.l, iw.item FROM dw JOIN iw ON dw.win = iw.win AND dw.l = iw.l),
spots AS (SELECT doc_id, unnest(generate_series(k, k + l - 1)) AS pos FROM (SELECT DISTINCT doc_id, k, l FROM h) x),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM spots GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_negatives": """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS DISTINCT FROM false),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other_id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
