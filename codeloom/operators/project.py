"""Metrics and insights of a project: one aggregation over the facts of all files (detect.engine.facts), nothing is read twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(kind: str, *names: str) -> Column:
    return (F.col("kind") == kind) & F.col("name").isin(*names)


def _value(name: str) -> Column:
    return F.when(_of("measure", name), F.col("value"))


def total(name: str) -> Column:
    return F.coalesce(F.sum(_value(name)), F.lit(0.0))


def mean(name: str) -> Column:
    return F.coalesce(F.avg(_value(name)), F.lit(0.0))


def most(name: str) -> Column:
    return F.coalesce(F.max(_value(name)), F.lit(0.0))


def n_measured(name: str) -> Column:
    return F.count(_value(name)).cast("double")


def n_issues(*rules: str, severity: str | None = None, prefix: str | None = None) -> Column:
    """Issues of the analyzer: all, those of the rules, of the prefix, of the severity."""
    c = F.col("kind") == "issue"
    c = c & F.col("name").isin(*rules) if rules else c
    c = c & F.col("name").startswith(prefix) if prefix else c
    c = c & (F.col("severity") == severity) if severity else c
    return F.count_if(c).cast("double")


def share(a: Column, b: Column, empty: float, scale: float = 100.0) -> Column:
    return F.when(b > 0, a / b * scale).otherwise(F.lit(empty))


#: Thresholds, and whether more is better, which the observed reading (value <= threshold) disregards
LIMITS = {
    "average_cyclomatic_complexity": (10, False),
    "max_cyclomatic_complexity": (10, False),
    "average_cognitive_complexity": (15, False),
    "max_cognitive_complexity": (15, False),
    "average_essential_complexity": (4, False),
    "max_nesting_depth": (4, False),
    "average_npath_complexity": (200, False),
    "max_npath_complexity": (200, False),
    "average_halstead_volume": (8000, False),
    "average_halstead_difficulty": (20, False),
    "average_halstead_bugs": (2, False),
    "total_vulnerabilities": (50, False),
    "critical_severity": (0, False),
    "high_severity": (5, False),
    "risk_score": (50, False),
    "taint_flows_detected": (0, False),
    "secrets_exposed": (0, False),
    "crypto_vulnerabilities": (0, False),
    "injection_vulnerabilities": (0, False),
    "violations_per_kloc": (10, False),
    "docstring_coverage": (80, True),
    "type_hint_coverage": (73, True),
    "average_lcom": (0.5, False),
    "average_cbo": (10, False),
    "average_rfc": (50, False),
    "average_wmc": (40, False),
    "solid_violations": (5, False),
    "architectural_smells": (3, False),
    "off_by_one_errors": (0, False),
    "overflow_risks": (0, False),
    "test_files_count": (1, True),
    "assertion_density": (1.5, True),
    "assertion_strength_score": (70, True),
    "test_smell_count": (10, False),
    "average_maintainability_index": (65, True),
    "average_readability_score": (70, True),
    "identifier_quality_score": (60, True),
    "documentation_coverage": (60, True),
}


@dataclass(frozen=True)
class Metric:
    name: str
    value: Column


def _mapped(values: dict[str, str]) -> Column:
    """The category of an issue's rule: the first key that the rule begins with."""
    return F.coalesce(*(F.when((F.col("kind") == "issue") & F.col("name").startswith(k), F.lit(v)) for k, v in values.items()))


def metrics_of(analyzer: str) -> list[Metric]:
    from ..detect.security import CWE, OWASP

    blocks = n_measured("cyclomatic")
    per_block = lambda name: share(total(name), blocks, 0.0, 1.0)
    files = n_measured("lines")
    functions = total("functions")
    classes = total("classes")
    known = {
        "complexity": lambda: [
            Metric("average_cyclomatic_complexity", mean("cyclomatic")), Metric("max_cyclomatic_complexity", most("cyclomatic")),
            Metric("average_cognitive_complexity", per_block("cognitive")), Metric("max_cognitive_complexity", most("cognitive")),
            Metric("average_essential_complexity", mean("essential")), Metric("max_nesting_depth", most("nesting")),
            Metric("average_npath_complexity", per_block("npath")), Metric("max_npath_complexity", most("npath")),
            Metric("average_halstead_volume", mean("halstead_volume")), Metric("average_halstead_difficulty", mean("halstead_difficulty")),
            Metric("average_halstead_bugs", mean("halstead_bugs")), Metric("average_halstead_effort", mean("halstead_effort")),
            Metric("average_halstead_time", mean("halstead_time")), Metric("total_functions", blocks),
        ],
        "security": lambda: [
            Metric("total_vulnerabilities", n_issues()), Metric("critical_severity", n_issues(severity="critical")), Metric("high_severity", n_issues(severity="high")),
            Metric("medium_severity", n_issues(severity="medium")),
            Metric("risk_score", F.least(F.lit(100.0), 10 * n_issues(severity="critical") + 5 * n_issues(severity="high") + 2 * n_issues(severity="medium") + n_issues(severity="low"))),
            Metric("taint_flows_detected", n_issues(prefix="TAINT_")), Metric("secrets_exposed", n_issues(prefix="SECRET_")),
            Metric("crypto_vulnerabilities", n_issues(prefix="CRYPTO_")), Metric("injection_vulnerabilities", n_issues(prefix="CWE-")),
            Metric("owasp_categories_affected", F.count_distinct(_mapped(OWASP)).cast("double")), Metric("cwe_types_detected", F.count_distinct(_mapped(CWE)).cast("double")),
        ],
        "style": lambda: [
            Metric("total_violations", n_issues()), Metric("naming_violations", n_issues(prefix="PEP8_NAMING_")),
            Metric("consistency_issues", n_issues("PEP8_LINE_LENGTH", "PEP8_TRAILING_WHITESPACE")), Metric("total_lines", total("lines")),
            Metric("violations_per_kloc", share(n_issues(), total("lines"), 0.0, 1000.0)),
            Metric("docstring_coverage", share(total("functions_documented"), functions, 100.0)),
            Metric("type_hint_coverage", share(total("functions_hinted"), functions, 100.0)), Metric("files_analyzed", files),
        ],
        "architecture": lambda: [
            Metric("average_lcom", mean("lcom")), Metric("average_cbo", mean("cbo")), Metric("average_rfc", mean("rfc")), Metric("average_wmc", mean("wmc")),
            Metric("abstractness", share(total("abstract_methods"), classes, 0.0, 1.0)), Metric("solid_violations", n_issues(prefix="SOLID-")),
            Metric("architectural_smells", n_issues(prefix="SMELL-")),
        ],
        "edge_cases": lambda: [
            Metric("total_edge_case_issues", n_issues()), Metric("boundary_value_issues", n_issues("EDGE_BVA001")), Metric("validation_gaps", n_issues("EDGE_VAL001", "EDGE_BVA002")),
            Metric("off_by_one_errors", n_issues("EDGE_OBOE001")), Metric("null_handling_issues", n_issues("EDGE_NULL001")),
            Metric("overflow_risks", n_issues("EDGE_OVF001", "EDGE_OVF002")), Metric("functions_analyzed", functions),
        ],
        "test_quality": lambda: [
            Metric("test_files_count", n_measured("duplication")), Metric("total_test_functions", n_measured("assertions")), Metric("total_assertions", total("assertions")),
            Metric("assertion_density", F.round(share(total("assertions"), n_measured("assertions"), 0.0, 1.0), 2)),
            Metric("assertion_strength_score", F.round(share(total("assertions") - total("weak_assertions"), total("assertions"), 0.0), 2)),
            Metric("test_smell_count", n_issues(*(f"TEST_SMELL_00{k}" for k in range(2, 8)))),
        ],
        "cognitive_load": lambda: [
            Metric("average_maintainability_index", F.round(mean("maintainability"), 2)), Metric("average_readability_score", F.round(mean("readability"), 2)),
            Metric("average_cognitive_complexity", F.round(mean("cognitive"), 2)), Metric("identifier_quality_score", F.round(mean("identifier_quality"), 2)),
            Metric("average_identifier_entropy", F.round(mean("identifier_entropy"), 3)),
            Metric("documentation_coverage", F.round(share(total("documented_entities"), total("public_entities"), 0.0), 1)),
            Metric("low_mi_files", n_issues("COGN-MI")), Metric("low_readability_files", n_issues("COGN-READABILITY")), Metric("high_complexity_files", n_issues("COGN-COMPLEXITY")),
        ],
        "custom_rules": lambda: [
            Metric("total_violations", n_issues()), Metric("taint_flows_detected", n_issues("TAINT001")), Metric("code_smells_detected", n_issues("SMELL001")),
        ],
    }
    return known[analyzer]()


def wide_metrics(found: DataFrame, analyzer: str) -> DataFrame:
    """One row: every metric of the analyzer as a column."""
    return found.filter(F.col("analyzer") == analyzer).agg(*(m.value.alias(m.name) for m in metrics_of(analyzer)))


def metrics(found: DataFrame, analyzer: str) -> DataFrame:
    """analyzer, name, value, threshold, passed (value <= threshold, as observed), intended (by the metric's direction)."""
    rows = []
    for m in metrics_of(analyzer):
        threshold, higher = LIMITS.get(m.name, (None, False))
        v, limit = F.col(m.name), F.lit(threshold).cast("double")
        rows.append(F.struct(F.lit(m.name).alias("name"), v.alias("value"), limit.alias("threshold"), (v <= limit).alias("passed"), ((v >= limit) if higher else (v <= limit)).alias("intended")))
    return wide_metrics(found, analyzer).select(F.lit(analyzer).alias("analyzer"), F.explode(F.array(*rows)).alias("m")).select("analyzer", "m.*")


# What is said of a project. Condition and arguments are SQL over the analyzer's wide metrics; the first condition
# of a list that holds speaks.
INSIGHTS: dict[str, tuple[tuple[tuple[str, str, tuple[str, ...]], ...], ...]] = {
    "complexity": (
        (("average_cyclomatic_complexity <= 5", "Excellent cyclomatic complexity (avg: %.1f). Code is well-structured.", ("average_cyclomatic_complexity",)),
         ("average_cyclomatic_complexity <= 10", "Good cyclomatic complexity (avg: %.1f). Within McCabe threshold.", ("average_cyclomatic_complexity",)),
         ("true", "High cyclomatic complexity (avg: %.1f). Refactoring recommended.", ("average_cyclomatic_complexity",))),
        (("average_cognitive_complexity <= 10", "Low cognitive load (avg: %.1f). Code is readable.", ("average_cognitive_complexity",)),
         ("average_cognitive_complexity <= 15", "Moderate cognitive complexity (avg: %.1f).", ("average_cognitive_complexity",)),
         ("true", "High cognitive complexity (avg: %.1f). Difficult to understand.", ("average_cognitive_complexity",))),
        (("average_halstead_bugs < 0.5", "Low predicted defect rate (%.2f bugs per file).", ("average_halstead_bugs",)),
         ("average_halstead_bugs < 2", "Moderate predicted defects (%.2f bugs per file).", ("average_halstead_bugs",)),
         ("true", "High predicted defect rate (%.2f bugs per file). Thorough testing needed.", ("average_halstead_bugs",))),
        (("max_nesting_depth > 5", "Excessive nesting detected (max: %d levels).", ("max_nesting_depth",)), ("max_nesting_depth > 4", "High nesting depth (max: %d). Consider flattening structure.", ("max_nesting_depth",))),
        (("max_npath_complexity > 1000", "Extremely high NPATH (%d paths). Comprehensive testing is impractical.", ("max_npath_complexity",)),
         ("max_npath_complexity > 200", "High NPATH complexity (%d paths). Testing will be challenging.", ("max_npath_complexity",))),
        (("average_cyclomatic_complexity > 10 AND average_cognitive_complexity > 15", "Both cyclomatic and cognitive complexity are high. Immediate refactoring required.", ()),),
        (("average_essential_complexity > 2", "High essential complexity (%.1f). Code has non-structured patterns.", ("average_essential_complexity",)),),
        (("total_functions > 0", "Analyzed %d functions across project.", ("total_functions",)),),
    ),
    "security": (
        (("total_vulnerabilities = 0", "No security vulnerabilities detected! Excellent security posture.", ()),),
        (("critical_severity > 0", "CRITICAL: %d critical vulnerabilities require immediate attention!", ("critical_severity",)),),
        (("high_severity > 5", "Found %d high-severity vulnerabilities. Prioritize remediation.", ("high_severity",)),),
        (("secrets_exposed > 0", "SECRETS: %d hardcoded credentials detected (23M+ exposed in 2024). Move to secure vault immediately.", ("secrets_exposed",)),),
        (("taint_flows_detected > 0", "INJECTION: %d untrusted data flows to sensitive sinks. Validate and sanitize all inputs.", ("taint_flows_detected",)),),
        (("crypto_vulnerabilities > 0", "Weak cryptographic algorithms detected. Migrate to SHA-256, AES-256, and secrets module.", ()),),
        (("total_vulnerabilities > 0", "Total: %d vulnerabilities across %d OWASP categories. Implement defense-in-depth strategy.", ("total_vulnerabilities", "owasp_categories_affected")),),
    ),
    "style": (
        (("total_violations = 0", "Perfect code style! Zero violations detected.", ()),),
        (("naming_violations > 0", "%d naming convention issues. 70%% of source code is identifiers - naming is paramount for readability.", ("naming_violations",)),),
        (("total_violations > 0 AND docstring_coverage < 80", "Docstring coverage: %.1f%%. Add docstrings per PEP 257 for better maintainability.", ("docstring_coverage",)),),
        (("total_violations > 0 AND type_hint_coverage < 73", "Type hint coverage: %.1f%% (industry: 73%%). Benefits: IDE support, bug prevention, documentation.", ("type_hint_coverage",)),),
        (("total_violations > 50", "High violation count detected. Research shows 40%% reduction in onboarding time with PEP 8 compliance.", ()),),
    ),
    "architecture": (
        (("average_lcom > 0.7", "High average LCOM (%.2f) indicates low cohesion - consider splitting classes", ("average_lcom",)),),
        (("average_cbo > 10", "High average CBO (%.1f) indicates tight coupling - consider dependency injection", ("average_cbo",)),),
    ),
    "edge_cases": (
        (("total_edge_case_issues = 0", "No edge case issues detected across %d functions. Excellent!", ("functions_analyzed",)),
         ("total_edge_case_issues < 10", "Minor edge case concerns: %d issues found across %d functions.", ("total_edge_case_issues", "functions_analyzed")),
         ("true", "Significant edge case gaps: %d issues found. Review recommended.", ("total_edge_case_issues",))),
        (("off_by_one_errors > 0", "Critical: %d potential off-by-one errors detected. High bug probability.", ("off_by_one_errors",)), ("true", "No off-by-one errors detected in loops and slicing.", ())),
        (("overflow_risks > 5", "%d numeric overflow risks found. Consider using Decimal or validation.", ("overflow_risks",)), ("overflow_risks > 0", "Minor: %d potential overflow scenarios identified.", ("overflow_risks",))),
        (("validation_gaps > 10", "Input validation gaps: %d functions lack proper validation. Security risk.", ("validation_gaps",)), ("validation_gaps > 0", "Some validation gaps detected: %d functions.", ("validation_gaps",))),
        (("true", "Research shows 90%% of bugs arise from edge conditions. Thorough testing recommended.", ()),),
    ),
    "test_quality": (
        (("total_test_functions > 0", "Analyzed %d test functions with %d assertions", ("total_test_functions", "total_assertions")),),
        (("total_test_functions > 0", "Assertion density: %.2f assertions/test", ("assertion_density",)),),
        (("total_test_functions > 0", "Assertion strength: %.1f%% strong assertions", ("assertion_strength_score",)),),
        (("test_smell_count > 0", "Detected %d test smells across %d test files", ("test_smell_count", "test_files_count")),),
    ),
    "cognitive_load": (
        (("true", "Average Maintainability Index: %.1f/100", ("average_maintainability_index",)),),
        (("true", "Average Readability Score: %.1f/100", ("average_readability_score",)),),
        (("true", "Average Cognitive Complexity: %.1f", ("average_cognitive_complexity",)),),
        (("true", "Identifier Quality: %.1f/100 (Research: 70%% of comprehension impact)", ("identifier_quality_score",)),),
        (("average_maintainability_index >= 85", "Excellent maintainability - code is highly maintainable", ()), ("average_maintainability_index >= 65", "Good maintainability - minor improvements possible", ()),
         ("true", "Maintainability needs improvement - consider refactoring", ())),
        (("average_readability_score >= 80", "Excellent readability - code is very clear", ()), ("average_readability_score >= 70", "Good readability - code is generally clear", ()),
         ("true", "Readability needs improvement - focus on naming and structure", ())),
        (("identifier_quality_score < 50", "Critical: Poor identifier quality detected. Research shows identifiers are 70%% of code!", ()),),
        (("average_identifier_entropy > 4", "High identifier entropy (%.2f) - many unique names may increase cognitive load", ("average_identifier_entropy",)),),
        (("documentation_coverage < 40", "Low documentation coverage (%.0f%%) - add docstrings to improve comprehension", ("documentation_coverage",)),),
    ),
    "custom_rules": (
        (("total_violations = 0", "No custom rule violations found.", ()), ("total_violations < 10", "Found %d custom rule violations. Good code quality.", ("total_violations",)),
         ("true", "Found %d custom rule violations. Review recommended.", ("total_violations",))),
        (("taint_flows_detected > 0", "Security: %d potential taint flows detected. Review for injection vulnerabilities.", ("taint_flows_detected",)), ("true", "No taint flows detected. Good data sanitization practices.", ())),
        (("code_smells_detected > 5", "Code smells detected: %d. Consider refactoring for maintainability.", ("code_smells_detected",)),
         ("code_smells_detected > 0", "Minor code smells detected: %d. Optional improvements available.", ("code_smells_detected",))),
    ),
}
#: How many insights of an analyzer are kept
MOST_INSIGHTS = {"security": 5, "style": 5}


def insight_sql(analyzer: str, printf: str = "format_string") -> list[str]:
    """One SQL expression per group of insights: the text, or null."""
    out = []
    for group in INSIGHTS[analyzer]:
        cases = []
        for condition, text, arguments in group:
            whole = [c for c in text.replace("%%", "").split("%")[1:]]
            args = [f"CAST({a} AS BIGINT)" if w.startswith("d") else a for a, w in zip(arguments, whole)]
            cases.append(f"WHEN {condition} THEN {printf}('{text}'{''.join(', ' + a for a in args)})")
        out.append(f"CASE {' '.join(cases)} END")
    return out


def insights(wide: DataFrame, analyzer: str) -> DataFrame:
    """analyzer, insights (array) of one row of wide metrics."""
    said = F.array_compact(F.array(*(F.expr(e) for e in insight_sql(analyzer))))
    limit = MOST_INSIGHTS.get(analyzer)
    return wide.select(F.lit(analyzer).alias("analyzer"), (F.slice(said, 1, limit) if limit else said).alias("insights"))


def first_insights(results: DataFrame, n: int = 3) -> DataFrame:
    """The first n insights of each result, as the terminal report shows them."""
    return results.withColumn("insights", F.slice("insights", 1, n))


def principles(found: DataFrame, n: int = 3) -> DataFrame:
    """principle, n: the most frequent violated design principles, by name where equally frequent."""
    own = found.filter((F.col("kind") == "issue") & F.col("name").startswith("SOLID-"))
    return own.groupBy(F.substring("name", 7, 10).alias("principle")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "principle").limit(n)


def ranked_smells(found: DataFrame) -> DataFrame:
    """rule_id, n of test smells, the most frequent first."""
    own = found.filter((F.col("kind") == "issue") & F.col("name").startswith("TEST_SMELL_"))
    return own.groupBy(F.col("name").alias("rule_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def health(files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, state (parsed, syntax, too deep, empty), issues, failures (parts of detectors that failed) of every file."""
    error = F.max(F.when(F.col("kind") == "parse_error", F.when(F.col("name").isin("RecursionError", "MemoryError"), "too deep").otherwise("syntax")))
    counts = found.groupBy("file_id").agg(error.alias("error"), F.count_if(F.col("kind") == "issue").alias("issues"), F.count_if(F.col("kind") == "failure").alias("failures"))
    code = files.select("file_id", (F.coalesce(F.length("code"), F.lit(0)) == 0).alias("empty"))
    state = F.coalesce("error", F.when(F.col("empty"), "empty").otherwise("parsed"))
    return code.join(counts, "file_id", "left").select("file_id", state.alias("state"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("issues", "failures")))
