"""Tables as source files and findings, and a reader for source trees."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SEVERITIES, lookup
from .trees import LARGEST_KB, PATTERNS, listed, read_files

EVENT_SEVERITY = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Short rows that become code, dealt to all cores: a small table is one split, and parsing its code takes far longer than
    reading it."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def read_source_tree(spark: SparkSession, root: str, patterns=PATTERNS, ignore=(), largest_kb: float = LARGEST_KB) -> DataFrame:
    """Files under a directory (see trees.listed) or one file as source_file rows. Paths are listed on the driver, contents are
    read by the tasks."""
    return read_files(spark, listed(root, patterns, ignore, largest_kb) if Path(root).is_dir() else [root])


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"))
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), "code")


def lines(files: DataFrame) -> DataFrame:
    """file_id, line_no (from 1), line; a trailing line end opens an empty last line."""
    return files.select("file_id", F.posexplode(F.split("code", "\n", -1)).alias("k", "line")).select("file_id", (F.col("k") + 1).alias("line_no"), "line")


def events_as_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from events: the type gives severity and title, the user the file, the hour the line, the id the order."""
    e = table(spark, sf_dir, "events")
    severity = F.lit(SEVERITIES[-1])
    for kind, name in EVENT_SEVERITY.items():
        severity = F.when(F.col("event_type") == kind, name).otherwise(severity)
    category = F.when(F.col("user_id") % 3 == 0, "security").when(F.col("user_id") % 3 == 1, "style").otherwise("complexity")
    return e.select(
        category.alias("analyzer"), severity.alias("severity"), category.alias("category"), F.col("event_type").alias("title"),
        F.col("user_id").cast("string").alias("file_path"), F.hour("ts").alias("line_number"), F.upper("event_type").alias("rule_id"), F.col("event_id").alias("emit_seq"),
    )


__all__ = ["documents_as_files", "events_as_issues", "lines", "lookup", "read_source_tree", "spread", "table"]
