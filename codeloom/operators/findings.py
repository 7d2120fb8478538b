"""Operators on issue facts: deduplication, ranking, grouping, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CATEGORIES, SEVERITIES, severity_rank

KEYS = ("severity", "category", "title", "file_path", "line_number")


def dedup(issues: DataFrame) -> DataFrame:
    """The first issue (by emit_seq) of each key; nulls are equal. min_by keeps partial sums before the shuffle, unlike a window."""
    rest = [c for c in issues.columns if c not in KEYS]
    return issues.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "emit_seq").alias("r")).select(*KEYS, "r.*").select(issues.columns)


def top_n(issues: DataFrame, n: int = 10) -> DataFrame:
    """Severest first, then in order of emission."""
    return issues.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "emit_seq").limit(n)


def _all_keys(issues: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    keys = issues.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = issues.groupBy(column).agg(F.count("*").alias("n"))
    return keys.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def by_severity(issues: DataFrame) -> DataFrame:
    """All five severities, 0 where there is no issue."""
    return _all_keys(issues, "severity", SEVERITIES)


def by_category(issues: DataFrame) -> DataFrame:
    return _all_keys(issues, "category", CATEGORIES)


def cap(issues: DataFrame, group: str, n: int) -> DataFrame:
    """The first n issues of each group, which Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy("emit_seq")
    return issues.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def severity_share(issues: DataFrame) -> DataFrame:
    counts = by_severity(issues)
    total = F.sum("n").over(Window.partitionBy())  # five rows
    pct = F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0)
    return counts.select("severity", "n", pct.alias("pct"), F.floor(pct / 2.5).cast("int").alias("bar"))


def with_snippets(issues: DataFrame, files: DataFrame, around: int = 0) -> DataFrame:
    """issues (file_id, line_number, and more) with `snippet`: the line, with so many before and after it, without the white space
    at both ends; empty where there is no such line. Only the lines shown leave a file's row."""
    wanted = issues.filter("line_number > 0").select("file_id", "line_number").distinct()
    n, lines = F.col("line_number"), F.split("code", "\n", -1)
    first = F.greatest(n - around, F.lit(1))
    shown = F.array_join(F.slice(lines, first, n + around - first + 1), "\n")
    cut = files.join(wanted, "file_id").select("file_id", "line_number", F.when(n <= F.size(lines), F.regexp_replace(shown, r"^\s+|\s+$", "")).alias("snippet"))
    return issues.join(cut, ["file_id", "line_number"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))
