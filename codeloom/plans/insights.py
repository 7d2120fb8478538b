"""Metrics and insights of complexity and test quality, snippets of findings, projects without tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detect.test_code import DUPLICATED, likeness
from ..operators import findings, project
from ..sources.tables import documents_as_files, table
from . import pieces
from .detectors import SHAPES, TESTS_AT, C, T, disjoint, facts
from .mosaic import found_sql, total
from .queries import query

# --- complexity: a file has one piece, so Halstead's measures are known ------------------------------------------

_N = len(C)
_BLOCKS = ", ".join(f"({k}, {structured}, {cc}, {'NULL' if cog is None else cog}, {'NULL' if paths is None else paths})" for k, (structured, blocks) in enumerate(pieces.BLOCKS) for _, _, cc, cog, paths in blocks)
_HALSTEAD = ", ".join(f"({k}, {', '.join(map(str, h))}, {max([v for n, v in p.values if n == 'nesting'], default=0)})" for k, (h, p) in enumerate(zip(pieces.HALSTEAD, C)))
COMPLEXITY = f"""SELECT * FROM (SELECT avg(cc) AS average_cyclomatic_complexity, CAST(max(cc) AS DOUBLE) AS max_cyclomatic_complexity, CAST(sum(cognitive) AS DOUBLE) / count(*) AS average_cognitive_complexity, CAST(max(cognitive) AS DOUBLE) AS max_cognitive_complexity,
  avg(greatest(1, cc - structured + 1)) AS average_essential_complexity, CAST(sum(npath) AS DOUBLE) / count(*) AS average_npath_complexity, CAST(max(npath) AS DOUBLE) AS max_npath_complexity, CAST(count(*) AS DOUBLE) AS total_functions
  FROM part JOIN (VALUES {_BLOCKS}) b(k, structured, cc, cognitive, npath) ON p_partkey % {_N} = k),
 (SELECT avg(v) AS average_halstead_volume, avg(f) AS average_halstead_difficulty, avg(v / 3000) AS average_halstead_bugs, avg(v * f) AS average_halstead_effort, avg(v * f / 18) AS average_halstead_time, CAST(max(nesting) AS DOUBLE) AS max_nesting_depth
  FROM (SELECT nesting, CASE WHEN a + b > 0 THEN (x + y) * log2(a + b) ELSE 0.0 END AS v, CASE WHEN b > 0 THEN a / 2.0 * y / b ELSE 0.0 END AS f FROM part JOIN (VALUES {_HALSTEAD}) h(k, a, b, x, y, nesting) ON p_partkey % {_N} = k))"""

# --- test quality -------------------------------------------------------------------------------------------------

_D = disjoint(T)
_TWICE = int(likeness(*SHAPES) > DUPLICATED)
_SMELLS = f"(SELECT count(*) FROM ({found_sql(_D, lambda r: r.startswith('TEST_SMELL_') and r not in ('TEST_SMELL_001',))}))"
TEST_QUALITY = f"""SELECT CAST(count(*) AS DOUBLE) AS test_files_count, CAST(sum(tests) AS DOUBLE) AS total_test_functions, CAST(sum(assertions) AS DOUBLE) AS total_assertions, round(CAST(sum(assertions) AS DOUBLE) / sum(tests), 2) AS assertion_density,
 round(100.0 * (sum(assertions) - sum(weak)) / sum(assertions), 2) AS assertion_strength_score, CAST({_SMELLS} + {_TWICE} * count(*) FILTER (twice) AS DOUBLE) AS test_smell_count
 FROM (SELECT {total(_D, 'tests')} AS tests, {total(_D, 'assertions')} AS assertions, {total(_D, 'weak_assertions')} AS weak, p_partkey % {len(T)} = 7 AS twice FROM part)"""

_FOUND = {
    "complexity": (COMPLEXITY, lambda spark, d: facts(spark, d, disjoint(C), "complexity")),
    "test_quality": (TEST_QUALITY, lambda spark, d: facts(spark, d, _D, "test_quality", TESTS_AT)),
}


#: A metric's names stand here because expressions of metrics need a session, which importing this module does not
NAMES = {
    "complexity": ("average_cyclomatic_complexity", "max_cyclomatic_complexity", "average_cognitive_complexity", "max_cognitive_complexity", "average_essential_complexity", "max_nesting_depth", "average_npath_complexity", "max_npath_complexity",
                   "average_halstead_volume", "average_halstead_difficulty", "average_halstead_bugs", "average_halstead_effort", "average_halstead_time", "total_functions"),
    "test_quality": ("test_files_count", "total_test_functions", "total_assertions", "assertion_density", "assertion_strength_score", "test_smell_count"),
}


def _metrics_sql(analyzer: str) -> str:
    out = []
    for name in NAMES[analyzer]:
        limit, higher = project.LIMITS.get(name, (None, False))
        limit = "CAST(NULL AS DOUBLE)" if limit is None else f"CAST({limit} AS DOUBLE)"
        out.append(f"SELECT '{analyzer}' AS analyzer, '{name}' AS name, round({name}, 6) AS value, {limit} AS threshold, {name} <= {limit} AS passed, {name} {'>=' if higher else '<='} {limit} AS intended FROM w")
    return f"WITH w AS ({_FOUND[analyzer][0]}) " + " UNION ALL ".join(out)


def _register(analyzer: str, metrics_name: str) -> None:
    found = _FOUND[analyzer][1]

    def metrics(spark, d):
        return project.metrics(found(spark, d), analyzer).withColumn("value", F.round("value", 6))

    def said(spark, d):
        own = project.insights(project.wide_metrics(found(spark, d), analyzer), analyzer)
        return own.select("analyzer", F.array_join("insights", " | ").alias("insights"))

    metrics.__name__, said.__name__ = metrics_name, f"{analyzer}_insights"
    query(_metrics_sql(analyzer))(metrics)
    listed = f"list_filter([{', '.join(project.insight_sql(analyzer, 'printf'))}], lambda x: x IS NOT NULL)"
    query(f"WITH w AS ({_FOUND[analyzer][0]}) SELECT '{analyzer}' AS analyzer, array_to_string({listed}, ' | ') AS insights FROM w")(said)


_register("complexity", "complexity_with_halstead")
_register("test_quality", "test_quality_metrics")


# --- snippets -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(n_chars % 5 AS INTEGER) AS line_number, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
 SELECT file_id, line_number, CASE WHEN line_number BETWEEN 1 AND len(lines) THEN regexp_replace(array_to_string(lines[greatest(line_number - 1, 1):line_number + 1], chr(10)), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') ELSE '' END AS snippet FROM l""")
def issue_snippets(spark, d):
    """A finding in every document, with a line before and after it."""
    docs = table(spark, d, "documents")
    issues = docs.select(F.col("doc_id").cast("string").alias("file_id"), (F.col("n_chars") % 5).cast("int").alias("line_number"))
    return findings.with_snippets(issues, documents_as_files(spark, d), 1)
