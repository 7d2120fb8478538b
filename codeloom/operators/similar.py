"""Pairs over all files without comparing all with all: names by edit distance, tests by the shape of their trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Tables

#: Names up to this length are not compared
SHORT = 3


def _without_one(names: Column) -> Column:
    """All texts that are left when one character goes."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.when(F.length(n) > 0, cut(n)).otherwise(F.array().cast("array<string>")))))


def similar_names(names: DataFrame, most: int = 2) -> DataFrame:
    """a, b, distance of all pairs of distinct names (column `name`) of over SHORT characters, a < b, within an edit distance of
    `most` and of a third of the shorter one's length. Two names within a distance of k have a text in common that each becomes
    by k deletions at most: names are joined on these texts, so none is compared with one that it shares none with. A name of n
    characters has some n^most / 2 of them. The result is as large as there are such pairs. Null names are none."""
    each = names.filter(F.length("name") > SHORT).select("name").distinct()
    variants = F.array(F.col("name"))
    layer, every = variants, variants
    for k in range(most):
        layer = _without_one(layer)
        every = F.when(F.length("name") >= 3 * (k + 1), F.concat(every, layer)).otherwise(every)
    keyed = each.select("name", F.explode(F.array_distinct(every)).alias("v")).select("name", F.xxhash64("v").alias("v"))
    pairs = keyed.select(F.col("name").alias("a"), "v").join(keyed.select(F.col("name").alias("b"), "v"), "v").filter("a < b").select("a", "b").distinct()
    bound = F.least(F.lit(most), F.floor(F.least(F.length("a"), F.length("b")) / 3))
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= bound)


def shapes(found: DataFrame) -> DataFrame:
    """file_id, name, line_number, tokens (sorted, distinct) of every test."""
    own = found.filter("kind = 'shape'")
    return own.select("file_id", "name", "line_number", F.array_sort(F.split("detail", " ")).alias("tokens"))


def duplicated_tests(tests: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Members and pairs. Members: file_id, name, line_number, class of every test of `tests` (shapes()); a class are the tests with
    equal shapes. Pairs: class, other, shared, all, likeness of classes whose shapes have `percent` percent or more of their
    tokens in common (100 x shared >= percent x all); class < other. Every shape's tokens are ordered from rare to frequent; two
    shapes that are alike enough share one of the first few, and differ little in size."""
    stored = Tables()
    keyed = tests.withColumn("class", F.sha2(F.array_join("tokens", " "), 256))
    members = keyed.select("file_id", "name", "line_number", "class")
    one = stored(keyed.groupBy("class").agg(F.first("tokens").alias("tokens")), "shapes")
    frequency = one.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = one.select("class", F.explode("tokens").alias("token")).join(frequency, "token")
    # tokens of a shape in one row: as many as a function has nodes
    ordered = stored(ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).select("class", F.col("t.token").alias("tokens"), F.size("t").alias("size")), "ordered")
    first = ordered.select("class", "size", F.explode(F.slice("tokens", F.lit(1), F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1)).alias("token"))
    other = first.toDF("other", "other_size", "token")
    close = (F.col("size") * 100 >= F.col("other_size") * percent) & (F.col("other_size") * 100 >= F.col("size") * percent)
    candidates = first.join(other, "token").filter((F.col("class") < F.col("other")) & close).select("class", "other").distinct()
    whole = candidates.join(ordered.select("class", F.col("tokens").alias("a")), "class").join(ordered.select(F.col("class").alias("other"), F.col("tokens").alias("b")), "other")
    shared = F.size(F.array_intersect("a", "b"))
    pairs = whole.select("class", "other", shared.alias("shared"), (F.size("a") + F.size("b") - shared).alias("all")).filter(F.col("shared") * 100 >= F.col("all") * percent)
    pairs = stored.last(pairs.withColumn("likeness", F.col("shared") / F.col("all")), "pairs")
    return members, pairs
