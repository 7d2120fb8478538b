"""Rule DSL over lines: regular expressions with excludes, required and forbidden patterns, counts per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules above this number are joined in the ordinary way; below, a table of at most so many short rows is broadcast.
BROADCAST_RULES = 10_000


def rule_table(spark, rules: list[dict]) -> DataFrame:
    rows = [(r["id"], r.get("severity", "medium"), r["pattern"], list(r.get("excludes", [])), list(r.get("requires", []))) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, severity string, pattern string, excludes array<string>, requires array<string>")


def regex_hits(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_id, severity, file_id, line_no, hit (first match) for lines that match and hold none of the excludes. The rules
    are literals of the plan, so lines are read once and never joined."""
    found = []
    for r in rules:
        skip = F.lit(False)
        for word in r.get("excludes", []):
            skip |= F.col("line").contains(word)
        found.append(F.when(F.col("line").rlike(r["pattern"]) & ~skip, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "medium")).alias("severity"), F.regexp_extract("line", r["pattern"], 0).alias("hit"))))
    every = lines.select("file_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("r"))
    return every.select("r.rule_id", "r.severity", "file_id", "line_no", "r.hit")


def required(files: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_id, file_id of files that hold every word a rule requires (a rule without any applies everywhere)."""
    words = F.array_distinct(F.split(F.lower("code"), "[^a-z]+"))
    tests = [F.when(F.size(F.array_except(F.array(*map(F.lit, r["requires"])), words)) == 0 if r.get("requires") else F.lit(True), F.lit(r["id"])) for r in rules]
    return files.select("file_id", F.explode(F.array_compact(F.array(*tests))).alias("rule_id")).select("rule_id", "file_id")


def counts(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of every rule, 0 included."""
    n = hits.groupBy("rule_id").agg(F.count("*").alias("violations"))
    return rules.select("rule_id").join(n, "rule_id", "left").select("rule_id", F.coalesce("violations", F.lit(0)).alias("violations"))
