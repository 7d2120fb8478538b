"""Scores: metric thresholds, penalties, pass ratios, weighted total and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PENALTY, RISK, WEIGHTS, grade, lookup


def passed(value: Column, threshold: Column, higher_is_better: Column | None = None) -> Column:
    """Null without a threshold or value. Observed mode compares value <= threshold whatever the direction; pass
    higher_is_better for the corrected mode."""
    low = value <= threshold
    return low if higher_is_better is None else F.when(higher_is_better, value >= threshold).otherwise(low)


def penalties(issues: DataFrame) -> DataFrame:
    """analyzer, penalty (at most 1), risk (at most 100) and the penalty that leaves INFO out."""
    p, r = lookup(PENALTY, F.col("severity")), lookup(RISK, F.col("severity")).cast("long")
    free = F.when(F.col("severity") == "info", 0.0).otherwise(p)
    return issues.groupBy("analyzer").agg(F.least(F.lit(1.0), F.sum(p)).alias("penalty"), F.least(F.lit(100), F.sum(r)).cast("long").alias("risk"), F.least(F.lit(1.0), F.sum(free)).alias("engine_penalty"))


def pass_ratio(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("analyzer").agg(F.avg(F.col("passed").cast("double")).alias("ratio"))


def analyzer_scores(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """analyzer, score_7030 (0.7 pass ratio + 0.3 (1 - penalty)), score_observed (pass ratio, or 1 - penalty without metrics)."""
    both = penalties(issues).join(pass_ratio(metrics), "analyzer", "full")
    ratio, pen, eng = F.col("ratio"), F.coalesce("penalty", F.lit(0.0)), F.coalesce("engine_penalty", F.lit(0.0))
    return both.select("analyzer", (0.7 * F.coalesce(ratio, F.lit(1.0)) + 0.3 * (1 - pen)).alias("score_7030"), F.coalesce(ratio, F.greatest(F.lit(0.0), 1 - eng)).alias("score_observed"))


def overall(scores: DataFrame, column: str = "score_observed") -> DataFrame:
    """score (0-100, by the weights of the analyzers that are present) and grade."""
    w = lookup(WEIGHTS, F.col("analyzer"))
    total = F.when(F.sum(w) > 0, F.sum(F.col(column) * w) / F.sum(w) * 100).otherwise(0.0)
    return scores.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).alias("score")).select("score", grade(F.col("score")).alias("grade"))
