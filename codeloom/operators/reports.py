"""Reports that other tools have written, as findings and metrics. Nothing is run here: a report's text is the column
`report`. A text that is not the tool's JSON gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities by the tools' own words and code letters.
BANDIT = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
RUFF = {"E": "low", "W": "info", "F": "medium", "C": "info", "N": "low"}


def _severity(values: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _findings(rows: DataFrame, path: str, severity: Column, rule: str, title: str, line: str) -> DataFrame:
    return rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("file_path"), severity.alias("severity"), F.col(rule).alias("rule_id"), F.col(title).alias("title"), F.col(line).cast("long").alias("line_number"))


def bandit(reports: DataFrame) -> DataFrame:
    schema = "results array<struct<filename:string,issue_severity:string,issue_text:string,line_number:long,test_id:string>>"
    rows = reports.select(F.explode(F.from_json("report", schema)["results"]).alias("r"))
    return _findings(rows, "r.filename", _severity(BANDIT, F.upper("r.issue_severity"), "medium"), "r.test_id", "r.issue_text", "r.line_number")


def ruff(reports: DataFrame) -> DataFrame:
    schema = "array<struct<code:string,filename:string,message:string,location:struct<row:long>>>"
    rows = reports.select(F.explode(F.from_json("report", schema)).alias("r"))
    return _findings(rows, "r.filename", _severity(RUFF, F.substring("r.code", 1, 1), "low"), "r.code", "r.message", "r.location.row")


def flake8(reports: DataFrame) -> DataFrame:
    schema = "map<string,array<struct<code:string,text:string,line_number:long>>>"
    rows = reports.select(F.explode(F.from_json("report", schema)).alias("path", "found")).select("path", F.explode("found").alias("r"))
    return _findings(rows, "path", F.lit("low"), "r.code", "r.text", "r.line_number")


def coverage(reports: DataFrame) -> DataFrame:
    """All columns but `report`, and statement and branch coverage, effectiveness (0.6 and 0.4 of them) and whether branches are too few."""
    t = F.from_json("report", "totals struct<percent_covered:double,num_branches:long,covered_branches:long>")["totals"]
    rest = [c for c in reports.columns if c != "report"]
    rows = reports.select(*rest, t.alias("t")).filter("t is not null")
    n, statement = F.coalesce("t.num_branches", F.lit(0)), F.coalesce("t.percent_covered", F.lit(0.0))
    branch = F.when(n > 0, F.coalesce("t.covered_branches", F.lit(0)) / n * 100).otherwise(0.0)
    return rows.select(*rest, statement.alias("statement"), branch.alias("branch"), (0.6 * statement + 0.4 * branch).alias("effectiveness"), ((branch < 70) & (n > 0)).alias("low_branch"))


def location(path: Column, line: Column, column: Column) -> Column:
    """path[:line[:column]]; 0 and null are left out, and a column without a line too."""
    at = F.nullif(line, F.lit(0))
    return F.concat_ws(":", path, at.cast("string"), F.when(at.isNotNull(), F.nullif(column, F.lit(0))).cast("string"))


def merge(results: DataFrame) -> DataFrame:
    """Results of one analyzer merged in order of `seq`: seconds summed, issues counted, and the first status that is not a
    success, else success."""
    bad = F.min_by("status", F.when(F.col("status") != "success", F.col("seq")))
    return results.groupBy("analyzer").agg(F.sum("seconds").alias("seconds"), F.sum("n_issues").alias("n_issues"), F.coalesce(bad, F.lit("success")).alias("status"))


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """Of each analyzer's metrics of one name, the last one by `seq`."""
    return metrics.groupBy("analyzer", "name").agg(F.max_by("value_num", "seq").alias("value_num"))
