"""Operators on analyzers' results, reports and settings: selections, groups, merging, the summary, validation, caches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORIES, SEVERITIES, WEIGHTS

# Fixed values
SUCCESS, FAILED, SKIPPED = "success", "failed", "skipped"


def selected(issues: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Issues of the severity, of the category, or both; of a result or of a whole report."""
    for column, value in (("severity", severity), ("category", category)):
        issues = issues if value is None else issues.filter(F.col(column) == value)
    return issues


def flattened(results: DataFrame) -> DataFrame:
    """All issues of all results (analyzer, seq, issues array), in the order of the results and within them."""
    return results.select("analyzer", "seq", F.posexplode("issues").alias("place", "issue")).select("analyzer", "seq", "place", "issue.*")


def grouped(issues: DataFrame, column: str) -> DataFrame:
    """column, n, first and ids (emit_seq, rising) of the issues of every severity or category, none left out. A group's ids are
    as many as its issues, so this is for reports; count by findings.by_severity for more."""
    values = SEVERITIES if column == "severity" else CATEGORIES
    keys = issues.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    own = issues.groupBy(column).agg(F.sort_array(F.collect_list("emit_seq")).alias("ids"))
    return keys.join(own, column, "left").select(column, F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def metrics_by_analyzer(metrics: DataFrame) -> DataFrame:
    """analyzer, metrics (map from name to value)."""
    pairs = F.sort_array(F.collect_list(F.struct("name", "value")))
    return metrics.groupBy("analyzer").agg(F.map_from_entries(pairs).alias("metrics"))


def with_status(results: DataFrame, failed: bool = False) -> DataFrame:
    """The successful results, or the failed ones."""
    return results.filter(F.col("status") == (FAILED if failed else SUCCESS))


def enabled(analyzers: DataFrame, settings: DataFrame) -> DataFrame:
    """Analyzers that the settings (analyzer, enabled) do not switch off; those without a setting are on."""
    off = settings.filter(~F.col("enabled")).select("analyzer")
    return analyzers.join(F.broadcast(off), "analyzer", "left_anti")  # one row per analyzer at most


def setting(value: Column, default: float) -> Column:
    """A threshold's setting, or the default where it is null or 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def severest(issues: DataFrame, longest: int = 50) -> DataFrame:
    """Critical and high issues in order of emission, titles cut to `longest`."""
    return issues.filter(F.col("severity").isin("critical", "high")).withColumn("title", F.substring("title", 1, longest)).orderBy("emit_seq")


def merged(results: DataFrame) -> DataFrame:
    """One result out of those of one analyzer (analyzer, seq, status, seconds, issues, insights, metrics map) in the order of
    seq: issues and insights one after the other, of metrics with one name the last, seconds summed, the first status that is
    not a success. Results of different analyzers are an error."""
    entry = F.struct("seq", "status", "seconds", "issues", "insights", F.map_entries("metrics").alias("metrics"))  # maps have no order
    one = results.agg(F.min("analyzer").alias("analyzer"), F.max("analyzer").alias("other"), F.sort_array(F.collect_list(entry)).alias("r"))
    name = F.when(F.col("analyzer") == F.col("other"), F.col("analyzer")).when(F.col("analyzer").isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("results of different analyzers cannot be merged")))
    bad = F.get(F.filter("r", lambda x: x["status"] != SUCCESS), F.lit(0))["status"]
    pairs = F.flatten(F.col("r")["metrics"])
    keys = F.array_distinct(pairs["key"])
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"]
    return one.filter("size(r) > 0").select(
        name.alias("analyzer"), F.coalesce(bad, F.lit(SUCCESS)).alias("status"), F.aggregate("r", F.lit(0.0), lambda t, x: t + x["seconds"]).alias("seconds"),
        F.flatten(F.col("r")["issues"]).alias("issues"), F.flatten(F.col("r")["insights"]).alias("insights"),
        F.map_from_arrays(keys, F.transform(keys, last)).alias("metrics"),
    )


def summary(found: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """One row of 22 figures of a project: from the facts of its files, the files (path, code) themselves and the results
    (analyzer, status, seconds)."""
    from .project import mean, most

    path, name = F.lower("path"), F.lower(F.element_at(F.split("path", "/"), -1))
    python = F.col("path").endswith(".py")
    lines = F.size(F.split("code", "\n", -1)) - F.when(F.col("code").endswith("\n") | (F.col("code") == ""), 1).otherwise(0)
    of_files = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(lines), F.lit(0)).alias("total_lines"), F.count_if(python).alias("total_python_files"), F.count_if(python & (name.contains("test") | path.contains("/test"))).alias("total_test_files"))
    issue = F.col("kind") == "issue"
    blocks = lambda n: F.coalesce(F.sum(F.when((F.col("kind") == "measure") & (F.col("name") == n), F.col("value"))), F.lit(0)).cast("long")
    cognitive = F.sum(F.when((F.col("analyzer") == "complexity") & (F.col("name") == "cognitive"), F.col("value")))
    n_blocks = F.count(F.when(F.col("name") == "cyclomatic", 1))
    of_facts = found.agg(
        blocks("all_functions").alias("total_functions"), blocks("all_classes").alias("total_classes"), blocks("all_methods").alias("total_methods"),
        F.round(mean("cyclomatic"), 2).alias("avg_cyclomatic_complexity"), most("cyclomatic").cast("long").alias("max_cyclomatic_complexity"),
        F.round(F.when(n_blocks > 0, F.coalesce(cognitive, F.lit(0.0)) / n_blocks).otherwise(0.0), 2).alias("avg_cognitive_complexity"),
        F.count_if(issue).alias("total_issues"), *(F.count_if(issue & (F.col("severity") == s)).alias(f"{s}_issues") for s in SEVERITIES),
        F.round(mean("maintainability"), 2).alias("avg_maintainability_index"),
    )
    of_results = results.agg(
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("code_coverage"), F.coalesce(F.max("test_ratio"), F.lit(0.0)).alias("test_to_code_ratio"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("execution_time_seconds"), F.count_if(F.col("status") != SKIPPED).alias("analyzers_run"), F.count_if(F.col("status") == FAILED).alias("analyzers_failed"),
    )
    one = lambda t: t.withColumn("project", F.lit(1))
    return one(of_files).join(one(of_facts), "project").join(one(of_results), "project").drop("project")  # a row each


def successful_overall(scores: DataFrame, results: DataFrame) -> DataFrame:
    """score and grade from the scores of the analyzers that succeeded, by their weights."""
    from .scoring import overall

    return overall(scores.join(F.broadcast(with_status(results).select("analyzer")), "analyzer", "left_semi"))  # a row per analyzer


def exit_code(issues: DataFrame) -> DataFrame:
    """One row, code: 1 if any issue is critical, else 0."""
    return issues.agg(F.coalesce(F.max(F.when(F.col("severity") == "critical", 1)), F.lit(0)).alias("code"))


def fixes_by_category(fixes: DataFrame) -> DataFrame:
    """category, n, files (distinct)."""
    return fixes.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


# --- validation --------------------------------------------------------------------------------------------------


def is_github_url(text: Column) -> Column:
    return F.coalesce((text.startswith("http://") | text.startswith("https://")) & F.lower(text).contains("github.com"), F.lit(False))


def github_url_error(url: Column) -> Column:
    """What is wrong with the address of a repository, or null: it needs a scheme, the host, an owner and a name."""
    scheme, host = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(url, "^[^:]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^[^:]*://[^/?#]*([^?#]*)", 1)
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return F.when(url.isNull() | (scheme == "") | (host == ""), "invalid url").when(~F.lower(host).contains("github.com"), "not a GitHub url").when(parts < 2, "no owner and name")


def api_key_error(key: Column) -> Column:
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "required").when(F.length(key) < 10, "too short")


def pattern_error(pattern: Column) -> Column:
    return F.when(F.coalesce(F.length(pattern), F.lit(0)) == 0, "empty").when(pattern.startswith("/"), "starts with /")


def config_errors(config: dict[str, Any], ai: bool = False) -> list[str]:
    """What is wrong with the settings. A key is needed only where responses are asked for (`ai`)."""
    weights = config.get("analyzer_weights", WEIGHTS)
    checks = (
        (ai and not config.get("api_key"), "an API key is required"),
        (not config.get("file_patterns", ["**/*.py"]), "at least one file pattern is required"),
        (abs(sum(weights.values()) - 1) > 0.01, f"weights add up to {sum(weights.values()):g}, not 1"),
        (config.get("max_workers", 4) < 1, "max_workers must be at least 1"),
        (config.get("timeout_seconds", 300) < 1, "timeout_seconds must be at least 1"),
    )
    return [text for wrong, text in checks if wrong]


def load_config(path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings from the environment (ANALYZER_ and the upper-case name), over them those of a YAML file if there is one."""
    out: dict[str, Any] = {}
    for key, value in (environment or {}).items():
        if key.startswith("ANALYZER_"):
            name = key.removeprefix("ANALYZER_").lower()
            out[name] = int(value) if value.isdigit() else value
    if path:
        import yaml

        try:
            with open(path, encoding="utf-8") as f:
                out |= yaml.safe_load(f) or {}
        except FileNotFoundError:
            pass
    return out


# --- running -----------------------------------------------------------------------------------------------------


class Registry:
    """Analyzers by name: functions from a table of files to a table of facts."""

    def __init__(self):
        self.analyzers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, analyze: Callable[[DataFrame], DataFrame]) -> None:
        self.analyzers[name] = analyze

    def run(self, files: DataFrame, off: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Results (analyzer, status, message) and the stored facts of those that succeeded. A switched-off analyzer is
        skipped; one that fails, when planned or when run, costs the others nothing."""
        from ..sources.store import stored

        rows, facts = [], {}
        for name, analyze in self.analyzers.items():
            if name in off:
                rows.append((name, SKIPPED, None))
                continue
            try:
                facts[name] = stored(analyze(files), f"facts-{name}")
                rows.append((name, SUCCESS, None))
            except Exception as e:  # isolation: the failure is the result
                rows.append((name, FAILED, f"{type(e).__name__}: {e}"[:500]))
        return files.sparkSession.createDataFrame(rows, "analyzer string, status string, message string"), facts


# --- caches ------------------------------------------------------------------------------------------------------


def cache_key(*parts: Column) -> Column:
    """Key of a call with these arguments: the hash of their JSON."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 256)


def fresh(entries: DataFrame, now: Column, ttl_hours: float = 24) -> DataFrame:
    """Entries (written: timestamp) that are not older than the time to live."""
    return entries.filter(F.unix_micros(now) - F.unix_micros("written") <= F.lit(int(ttl_hours * 3_600_000_000)))


def least_recent_out(entries: DataFrame, now: Column, ttl_hours: float = 1, most: int = 1000) -> DataFrame:
    """The fresh entries (key, written, used), the `most` that were used last."""
    return fresh(entries, now, ttl_hours).orderBy(F.desc("used"), "key").limit(most)


def usage(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens and hit_rate (percent) of a log of calls (tokens, hit)."""
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(100.0 * F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("hit_rate"))
