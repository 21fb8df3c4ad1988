"""URL rules spread over redirect equivalence.

Rules (host, path) allow or block a host with its subdomains below a path; the longest fitting rule
decides.  Pages name other addresses by ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``;
addresses joined by such links are one class (distributed connected components).  A page without
a fitting rule is blocked if any address of its class is blocked by a rule, else allowed; an
explicit allow rule always stands for its own address.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; null html has no links; links to addresses that are no page still connect, and their own
rule counts; repeated rows get a row each; equal rules with different actions: allow wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import connected_components, materialized


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``action`` of the longest fitting rule to frames with ``host, path, _row``.

    Hosts are joined on equality with each of their suffixes, so rule tables of any size work.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixed = pages.select("_row", "path", F.explode(F.array_distinct(suffixes)).alias("_host"))
    rules = rules.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.min("action").alias("action"))  # allow < block
    fits = suffixed.join(rules, "_host").where(F.col("path").startswith(F.col("_path")))
    name = F.concat("_host", "_path")
    best = fits.groupBy("_row").agg(F.max_by(F.struct(name.alias("rule"), "action"), F.struct(F.length(name), name)).alias("_best"))
    return pages.join(best, "_row", "left").select(*pages.columns, "_best.rule", "_best.action")


def address(url: Column) -> Column:
    """Name of an address: host and the rest without fragment; schemes are one address."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def absolute(link: Column, base: Column) -> Column:
    """A link seen on a page as a full url; unusable ones are null."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    full = F.when(link.rlike(r"^(?i)https?://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
    full = full.when(link.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), link))
    return full.when(link.rlike(r"^[^:?#]+([?#]|$)"), F.concat(scheme, F.lit("://"), host_of(base), F.regexp_replace(path_of(base), r"[^/]*$", ""), link))


def alias_links(pages: DataFrame) -> DataFrame:
    """``a, b``: url of a page and the full url that it names as canonical or redirects to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    wanted = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = pages.where("html IS NOT NULL AND url IS NOT NULL").select("url", F.explode(wanted).alias("tag"))
    target = F.when(F.col("tag").rlike("(?i)^<link"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)", 1)).otherwise(F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    return found.select(F.col("url").alias("a"), absolute(F.nullif(target, F.lit("")), F.col("url")).alias("b")).where("b IS NOT NULL")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, class_id, class_blocked`` for every page row."""
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("_row"))
    own = materialized(with_rule(materialized(own, "urls"), rules), "urls-ruled").withColumn("_a", address(F.col("url")))
    pairs = materialized(alias_links(pages), "url-links")
    nodes = connected_components(pairs.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    nodes = nodes.select(F.col("node").alias("_a"), F.col("root").alias("class_id"))
    # Blocks of every address of a class: pages, and targets that are no page.
    ends = pairs.select(F.col("b").alias("url")).distinct().select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("_a"), F.xxhash64("url").alias("_row"))
    blocked = own.where("action = 'block'").select("_a").union(with_rule(ends, rules).where("action = 'block'").select("_a"))
    hit = blocked.join(nodes, "_a").select("class_id").distinct().withColumn("_hit", F.lit(True))
    classed = own.join(nodes, "_a", "left").join(hit, "class_id", "left")
    spread = F.coalesce("_hit", F.lit(False))
    verdict = F.coalesce("action", F.when(spread, F.lit("block")).otherwise(F.lit("allow")))
    return classed.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("class_id", "_a").alias("class_id"), spread.alias("class_blocked"))
