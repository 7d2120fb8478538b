"""Fixed vocabularies of the engine and the shape of its fact tables."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# Results depend on them.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = ("complexity", "security", "style", "architecture", "edge_case", "test_quality", "cognitive_load", "custom", "performance")
PENALTY = {"critical": 0.2, "high": 0.1, "medium": 0.05, "low": 0.02, "info": 0.01}
GRADES = (("A+", 95), ("A", 90), ("B+", 85), ("B", 80), ("C+", 75), ("C", 70), ("D", 60), ("F", 0))
WEIGHTS = {"complexity": 0.15, "security": 0.25, "style": 0.08, "architecture": 0.15, "edge_cases": 0.10, "test_quality": 0.15, "cognitive_load": 0.07, "custom_rules": 0.05}
RISK = {"critical": 10, "high": 5, "medium": 2, "low": 1}

ISSUE = T.StructType([
    T.StructField("analyzer", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line_number", T.IntegerType()),
    T.StructField("rule_id", T.StringType()), T.StructField("emit_seq", T.LongType()),
])
METRIC = "analyzer string, name string, value_num double, value_str string, threshold double, passed boolean"


def lookup(values: dict[str, float], key: Column, default: float = 0.0) -> Column:
    """A closed vocabulary as a CASE expression: no join, no shuffle."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return lookup({s: k for k, s in enumerate(SEVERITIES)}, severity, len(SEVERITIES)).cast("int")


def grade(score: Column) -> Column:
    """The first grade whose limit the score reaches; F below all."""
    out = F.lit(GRADES[-1][0])
    for name, least in reversed(GRADES[:-1]):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
