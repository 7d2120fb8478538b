"""Operator 12: what each filter of a chain removes, in every order of the chain.

A document's failures are one mask of bits, found by built-in expressions in one pass over the texts. A filter's fate in any
order depends on the masks alone: a document that fails the filters of mask m is there after the filters of a set S exactly
if m and S have no bit in common. So the corpus is counted into a histogram of 2^filters cells per part, and all orders are
read off the cells' sums; documents are never passed through the filters order by order.

Null texts are empty. Rows of one doc_id and one text are no copies of each other ("smaller" is meant strictly); a row without
a doc_id is a copy if any numbered row has its text. A null part is named by the empty string, together with an empty one.
A document is good (toxic) if any row of labels says so; labels of unknown documents count nowhere, and
a row without a doc_id has none. An empty table has no part,
so no rows. Columns besides those that are named are not read."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, Scratch

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
WHITE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; what is before the first and after the last one is no word."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def bits(*failures: Column) -> Column:
    """An integer with bit k set if failure k is true."""
    out = F.lit(0)
    for k, failed in enumerate(failures):
        out = out + F.when(failed, 1 << k).otherwise(0)
    return out


def text_failures(text: Column, split: Column) -> list[Column]:
    """Of the filters that look at one text alone, A to D. split: its words."""
    n = F.size(split)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < MIN_WORDS, 100 * F.size(F.array_distinct(split)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, good, toxic of every document. Copies are told by the SHA-256 of the text, so no text is shuffled; only
    texts that more than one row has are looked up."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("split", words(F.col("text")))
    own = bits(*text_failures(F.col("text"), F.col("split")))
    rows = scratch.write(seen.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null")
    least = scratch.write(least.select("digest", "least"), "copies")  # written, so that a join may split a text with many copies
    marked = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    all_bits = F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    joined = rows.join(least, "digest", "left").join(marked, "doc_id", "left")
    return joined.select("part", all_bits.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def histogram(masked: DataFrame) -> DataFrame:
    """Per part, cells by mask: documents, good ones, toxic ones. A cell that no document is in has zeros."""
    counts = [F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    cells = masked.groupBy("part", "mask").agg(*counts)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 2^filters at most
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    out = cells.groupBy("part").agg(by_mask.alias("cells"))
    dense = lambda k: F.transform(every, lambda m: F.coalesce(F.element_at("cells", m)[k], F.lit(0))).alias(k)
    return out.select("part", dense("n"), dense("good"), dense("toxic"))


def passing(counts: str) -> Column:
    """By set of filters, the documents that pass all of them."""
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    clear = lambda s: F.aggregate(every, F.lit(0).cast("long"), lambda total, m: total + F.when(m.bitwiseAND(s) == 0, F.element_at(counts, m + 1)).otherwise(0))
    return F.transform(every, clear)


def audit(masked: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(FILTERS)
    sums = histogram(masked).select("part", "n", *(passing(c).alias(f"pass_{c}") for c in ("n", "good", "toxic")))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = sums.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    by_letter = F.create_map(*(F.lit(x) for i, c in enumerate(FILTERS) for x in (c, 1 << i)))
    bit_of = lambda letter: F.element_at(by_letter, letter)
    letter = F.substring("filter_order", F.col("step"), 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bit_of(F.substring(F.col("filter_order"), i, 1))).otherwise(0))
    at = steps.withColumn("own", bit_of(letter)).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))
    passed = lambda c, s: F.element_at(f"pass_{c}", F.col(s) + 1)
    lost = lambda c: passed(c, "before") - passed(c, "after")
    failing = F.element_at("pass_n", F.lit(1)) - passed("n", "own")
    # over all orders, a set of j filters without the own one comes first in j! (k - 1 - j)! of them
    weights = F.array(*(F.lit(w) for w in _orders_with_prefix(k)))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    share = F.aggregate(sets, F.lit(0).cast("long"), lambda t, s: t + F.element_at(weights, F.bit_count(s) + 1) * (F.element_at("pass_n", s + 1) - F.element_at("pass_n", s + F.col("own") + 1)))
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), passed("n", "after").alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def _orders_with_prefix(k: int) -> list[int]:
    """By size of a set, the orders of k filters in which just this set stands before a given filter."""
    factorial = [1]
    for i in range(1, k + 1):
        factorial.append(factorial[-1] * i)
    return [factorial[j] * factorial[k - 1 - j] for j in range(k)]


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all of `documents`, in all 120 orders, per source."""
    scratch = Scratch(spark, "filter-audit")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scratch.last(audit(masks(docs, labels, scratch)))
