"""Operator 4: URL filters by association rules. DataFrame functions and Spark's own FP-growth only.

A list of (verdict, host/path) rules decides the URLs that it covers. These are the labels: FP-growth mines the
combinations of host and path tokens that go with `block` or `allow`. Rules of any length are pruned by support and
confidence, and by any shorter rule inside them that is as sure. An inverted index (token -> rules) finds the rules whose
tokens are all in a URL; the surest decides the URLs that the list leaves open, and `allow` where none matches.

URLs with the same tokens are judged once, so a host with a third of all pages costs one judgement per shape of URL.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, input_partitions, materialize

#: The list of the query: a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SUPPORT, CONFIDENCE = 0.01, 0.9


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (null without one) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path segments with digits as #, names of query parameters. Sorted."""
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)="), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(named("h:", F.split(host, "\\.")), named("p:", segments), named("q:", query))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, items, verdict, confidence, support from `labelled` (tokens, verdict). At most (mean tokens)/support items are
    frequent, so the number of rules does not grow with the input."""
    spark = labelled.sparkSession
    schema = "items array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], f"rule_id long, {schema}")
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("="), "verdict")).alias("items"))
    # confidence is filtered here, not by FPGrowth, so the model's rules are computed once
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=input_partitions(baskets)).fit(baskets)
    found = model.associationRules.select(F.array_sort("antecedent").alias("items"), F.col("consequent")[0].alias("to"), "confidence", "support")
    found = found.filter(F.col("to").startswith("=") & ~F.exists("items", lambda x: x.startswith("=")))
    found = found.select(F.xxhash64("items", "to").alias("rule_id"), "items", F.substring("to", 2, 99).alias("verdict"), "confidence", "support")
    found = materialize(found, "url-rules")
    short = found.select(F.col("rule_id").alias("short_id"), F.col("items").alias("short"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.explode("items").alias("item"))
    inside = found.withColumn("item", F.explode("items")).join(short, "item").filter((F.size("short") < F.size("items")) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("short", "items")) == 0))
    return found.join(inside.select("rule_id").distinct(), "rule_id", "left_anti")


def judge(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """key, verdict for each of `shapes` (key, tokens) that a rule matches: by the surest, then the best supported rule."""
    postings = rules.select(F.explode("items").alias("token"), "rule_id", F.size("items").alias("n"), "verdict", "confidence", "support")
    hits = shapes.select("key", F.explode("tokens").alias("token")).join(postings, "token")
    whole = hits.groupBy("key", "rule_id").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).filter("c = n")
    best = F.max(F.struct("confidence", "support", "n", "verdict", "rule_id"))
    return whole.groupBy("key").agg(best.alias("best")).select("key", F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url). Null urls and those without :// have an empty
    host and path and no tokens: they are allowed. Repeated rows are judged each."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    cut = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(cut.filter("rule is not null").select("tokens", F.col("listed").alias("verdict")), support, confidence)
    cut = cut.withColumn("key", F.when(F.col("rule").isNull(), F.xxhash64("tokens")))
    shapes = cut.filter("rule is null").select("key", "tokens").distinct()
    judged = judge(shapes, mined).withColumnRenamed("verdict", "judged")
    out = cut.filter("rule is null").join(judged, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("judged", F.lit("allow")).alias("verdict"))
    return cut.filter("rule is not null").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict")).unionByName(out)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
