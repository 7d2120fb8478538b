"""Queries on the detectors, each beside SQL that knows from the pieces what is in the code."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..detect import engine, rules, security
from ..operators import graph, project
from ..sources.tables import spread, table
from . import mosaic, pieces
from .mosaic import found_sql, line_total, total
from .queries import QUERIES, SQL, query

ISSUE = ("file_id", "rule_id", "severity", "title", "line_number")
KEY = "CAST(p_partkey AS VARCHAR)"


def disjoint(parts):
    """One piece per file."""
    return [replace(p, modulus=len(parts), rest=k) for k, p in enumerate(parts)]


def facts(spark, d, parts, analyzer, prefix="src/m"):
    return engine.facts(mosaic.files(spark, d, parts, prefix), analyzer)


def issue_query(name, parts, analyzer, *rules_, sql="", prefix="src/m"):
    """Registers the issues of an analyzer whose rules begin with one of the given texts."""
    keep = lambda rule: rule.startswith(rules_)

    def run(spark, d):
        chosen = F.lit(False)
        for r in rules_:
            chosen |= F.col("rule_id").startswith(r)
        return engine.issues(facts(spark, d, parts, analyzer, prefix)).filter(chosen).select(*ISSUE)

    run.__name__ = name
    own = found_sql(parts, keep)
    query(" UNION ALL ".join(x for x in (own, sql) if x))(run)


def file_issue(rule, severity, title, where, source="part", line="1"):
    return f"SELECT {KEY} AS file_id, '{rule}' AS rule_id, {severity} AS severity, {title} AS title, CAST({line} AS INTEGER) AS line_number FROM {source} WHERE {where}"


# --- security -----------------------------------------------------------------------------------------------------

issue_query("security_secrets", pieces.SECURITY, "security", "SECRET_")
issue_query("security_crypto", pieces.SECURITY, "security", "CRYPTO_")
issue_query("security_sql_injection", pieces.SECURITY, "security", "CWE-89")
issue_query("security_command_injection", pieces.SECURITY, "security", "CWE-78")
issue_query("security_code_injection", pieces.SECURITY, "security", "CWE-94")
issue_query("security_debug_flag", pieces.SECURITY, "security", "OWASP_A02")
issue_query("security_open_path", pieces.SECURITY, "security", "OWASP_A01")
issue_query("security_taint", pieces.SECURITY, "security", "TAINT_")


@query(f"SELECT file_id, lower(substr(rule_id, 8)) AS kind, CAST(line_number AS BIGINT) AS line_no FROM ({found_sql(pieces.SECURITY, lambda r: r.startswith('SECRET_'))})")
def secrets_scan(spark, d):
    """The same secrets as security_secrets finds, without Python."""
    from ..operators.text_metrics import secrets

    return secrets(mosaic.files(spark, d, pieces.SECURITY)).select("file_id", "kind", "line_no")


def _case(values, column):
    return "CASE " + " ".join(f"WHEN starts_with({column}, '{k}') THEN '{v}'" for k, v in values.items()) + " END"


@query(f"""SELECT category, count(*) AS n FROM (SELECT unnest([{_case(security.OWASP, 'rule_id')}, {_case(security.CWE, 'rule_id')}]) AS category FROM ({found_sql(pieces.SECURITY)})) WHERE category IS NOT NULL GROUP BY 1""")
def security_categories(spark, d):
    own = engine.issues(facts(spark, d, pieces.SECURITY, "security"))
    of = lambda values: F.coalesce(*(F.when(F.col("rule_id").startswith(k), v) for k, v in values.items()))
    return own.select(F.explode(F.array_compact(F.array(of(security.OWASP), of(security.CWE)))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


# --- style --------------------------------------------------------------------------------------------------------

S = pieces.STYLE
COVERED = f"""(SELECT p_partkey, {total(S, "functions")} AS f, {total(S, "classes")} AS c, {total(S, "functions_documented")} AS fd, {total(S, "classes_documented")} AS cd, {total(S, "functions_hinted")} AS h,
 {total(S, "very_long_lines")} AS v, {total(S, "trailing_whitespace")} AS t FROM part)"""
RATES = f"(SELECT *, CASE WHEN f + c = 0 THEN 100.0 ELSE 100.0 * (fd + cd) / (f + c) END AS doc, CASE WHEN f = 0 THEN 100.0 ELSE 100.0 * h / f END AS hint FROM {COVERED})"
COVERAGE_SQL = " UNION ALL ".join((
    file_issue("PEP257_COVERAGE", "'low'", "printf('Low docstring coverage: %.1f%%', CAST(doc AS DOUBLE))", "doc < 80", RATES),
    file_issue("TYPEHINT_COVERAGE", "'info'", "printf('Low type hint coverage: %.1f%%', CAST(hint AS DOUBLE))", "hint < 50", RATES),
))
LINE_SQL = " UNION ALL ".join((
    file_issue("PEP8_LINE_LENGTH", "'low'", "v || ' lines exceed 120 characters'", "v > 0", RATES),
    file_issue("PEP8_TRAILING_WHITESPACE", "'info'", "t || ' lines with trailing whitespace'", "t > 5", RATES),
))
issue_query("style_naming", S, "style", "PEP8_NAMING_NAMING_C", "PEP8_NAMING_NAMING_SINGLE")
issue_query("style_coverage", S, "style", "PEP257", "TYPEHINT", sql=COVERAGE_SQL)
issue_query("style_lines", S, "style", "PEP8_LINE", "PEP8_TRAILING", sql=LINE_SQL)

STYLE_MEASURES = ("functions", "functions_documented", "classes", "classes_documented", "functions_hinted", "arguments", "arguments_hinted", "returns_hinted", "long_lines", "very_long_lines", "trailing_whitespace", "single_quotes", "double_quotes")


@query("SELECT " + KEY + " AS file_id, " + ", ".join(f"CAST({total(S, m)} AS DOUBLE) AS {m}" for m in STYLE_MEASURES if m != "returns_hinted") + f", CAST(CASE WHEN {S[1].here} THEN 1 ELSE 0 END AS DOUBLE) AS returns_hinted, CAST({line_total(S)} AS DOUBLE) AS lines FROM part")
def style_measures(spark, d):
    return engine.file_measures(facts(spark, d, S, "style"), *STYLE_MEASURES, "lines")


# --- architecture -------------------------------------------------------------------------------------------------

A = pieces.ARCHITECTURE
for principle in ("SRP", "OCP", "LSP", "ISP", "DIP"):
    issue_query(f"architecture_{principle.lower()}", A, "architecture", f"SOLID-{principle}")
issue_query("architecture_god_class", A, "architecture", "SMELL-GOD_CLASS")
issue_query("architecture_feature_envy", A, "architecture", "SMELL-FEATURE_ENVY")
MODULES = f"""(SELECT p_partkey, CAST({total(A, "lcom")} AS DOUBLE) AS groups, {total(A, "classes")} AS classes, CAST({total(A, "cbo")} AS DOUBLE) AS cbo, CAST({total(A, "rfc")} AS DOUBLE) AS rfc, CAST({total(A, "wmc")} AS DOUBLE) AS wmc, {total(A, "abstract_methods")} AS abstract_methods FROM part)"""
LCOM = "CASE WHEN classes = 0 THEN 0.0 ELSE groups / classes END"


@query(f"SELECT {KEY} AS file_id, round({LCOM}, 9) AS lcom, cbo, rfc, wmc FROM {MODULES}")
def architecture_modules(spark, d):
    return engine.file_measures(facts(spark, d, A, "architecture"), "lcom", "cbo", "rfc", "wmc").withColumn("lcom", F.round("lcom", 9))


#: A file is one of 90 modules. It imports the one of a third of its number, and, of each ten of the first fifty, the next one of
#: them; above, the one of half of its number. So the first fifty are five rings, and no other module is imported by those that it imports.
MODULE = "p_partkey % 90"
IMPORTED = (f"({MODULE}) // 3", f"CASE WHEN {MODULE} < 50 THEN ({MODULE}) // 10 * 10 + ({MODULE} + 1) % 10 ELSE ({MODULE}) // 2 END")
IMPORTS = f"(SELECT DISTINCT 'm' || ({MODULE}) AS src, unnest(['m' || ({IMPORTED[0]}), 'm' || ({IMPORTED[1]})]) AS dst FROM part)"


def import_facts(spark, d):
    name = lambda e: F.concat(F.lit("m"), F.expr(e.replace("//", "div")).cast("string"))
    code = F.concat(F.lit("import "), name(IMPORTED[0]), F.lit(".inner\nfrom "), name(IMPORTED[1]), F.lit(" import x\nfrom . import y\n"))
    files = spread(table(spark, d, "part")).select(F.col("p_partkey").cast("string").alias("file_id"), F.concat(F.lit("src/"), name(MODULE), F.lit(".py")).alias("path"), code.alias("code"))
    return engine.facts(files, "architecture")


def import_edges(found):
    return found.filter("kind = 'edge'").select(F.col("scope").alias("src"), F.col("name").alias("dst")).distinct()


@query(f"SELECT * FROM {IMPORTS}")
def architecture_imports(spark, d):
    return import_edges(import_facts(spark, d))


NODES = f"(SELECT node, sum(o) AS ce, sum(i) AS ca FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {IMPORTS} UNION ALL SELECT dst, 0, 1 FROM {IMPORTS}) GROUP BY 1)"


@query(f"""SELECT round(i, 9) AS instability, round(a, 9) AS abstractness, round(abs(a + i - 1), 9) AS distance
 FROM (SELECT avg(CAST(ce AS DOUBLE) / (ce + ca)) AS i FROM {NODES}), (SELECT CAST(sum(abstract_methods) AS DOUBLE) / sum(classes) AS a FROM {MODULES})""")
def architecture_distance(spark, d):
    instability = graph.coupling(import_edges(import_facts(spark, d))).agg(F.avg("instability").alias("i"), F.lit(1).alias("one"))
    abstract = project.wide_metrics(facts(spark, d, A, "architecture"), "architecture").select(F.col("abstractness").alias("a"), F.lit(1).alias("one"))
    both = instability.join(abstract, "one")  # a row each
    return both.select(F.round("i", 9).alias("instability"), F.round("a", 9).alias("abstractness"), F.round(graph.distance(F.col("a"), F.col("i")), 9).alias("distance"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {IMPORTS} WHERE src <> dst), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
 SELECT a.src AS node, least(a.src, min(a.dst)) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def architecture_cycles(spark, d):
    return graph.cycles(import_edges(import_facts(spark, d)))


@query(f"SELECT substr(rule_id, 7) AS principle, count(*) AS n FROM ({found_sql(A)}) WHERE starts_with(rule_id, 'SOLID-') GROUP BY 1 ORDER BY n DESC, principle LIMIT 3")
def architecture_principles(spark, d):
    return project.principles(facts(spark, d, A, "architecture"))


# --- edge cases ---------------------------------------------------------------------------------------------------

E = pieces.EDGE_CASES
issue_query("edge_boundaries", E, "edge_cases", "EDGE_BVA001")
issue_query("edge_bounds_checks", E, "edge_cases", "EDGE_BVA002")
issue_query("edge_missing_else", E, "edge_cases", "EDGE_EP001", sql=file_issue("EDGE_EP001", "'low'", "'Incomplete Partition Coverage'", f"{total(E, 'missing_else')} > 3", line="NULL"))
issue_query("edge_zero_partition", E, "edge_cases", "EDGE_EP002")
issue_query("edge_input_validation", E, "edge_cases", "EDGE_VAL001")
issue_query("edge_off_by_one", E, "edge_cases", "EDGE_OBOE001")
issue_query("edge_none_checks", E, "edge_cases", "EDGE_NULL001")
issue_query("edge_overflow", E, "edge_cases", "EDGE_OVF002")
issue_query("edge_division", E, "edge_cases", "EDGE_OVF001")
CAPPED = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS place FROM ({SQL['edge_division']})) WHERE place <= 5"
SQL["edge_division"] = CAPPED


#: Subscripts of bare names by piece of EDGE_CASES
SUBSCRIPTS = {5: ((2, 2), (4, 1)), 6: ((1, 1), (2, 1))}


@query("SELECT file_id, count(*) AS n, min(line_number) AS first_line FROM (" + " UNION ALL ".join(
    f"SELECT {KEY} AS file_id, CAST({' + '.join(['0', *(f'CASE WHEN {q.here} THEN {q.code.count(chr(10))} ELSE 0 END' for q in E[:k])])} + {line} AS INTEGER) AS line_number FROM part, range({n}) WHERE {E[k].here}" for k, found in SUBSCRIPTS.items() for line, n in found) + ") GROUP BY 1")
def edge_empty_collections(spark, d):
    from ..detect.edge_cases import empty_collections

    found = engine.facts(mosaic.files(spark, d, E), extra={"edge_cases": empty_collections})
    return found.groupBy("file_id").agg(F.count("*").alias("n"), F.min("line_number").alias("first_line"))


# --- test quality -------------------------------------------------------------------------------------------------

T = pieces.TESTS
TESTS_AT = "tests/m"
issue_query("test_no_assertions", T, "test_quality", "TEST_ASSERT_001", prefix=TESTS_AT)
issue_query("test_roulette", T, "test_quality", "TEST_SMELL_001", prefix=TESTS_AT)
issue_query("test_long_eager_lazy", T, "test_quality", "TEST_SMELL_002", "TEST_SMELL_003", "TEST_SMELL_004", prefix=TESTS_AT)
issue_query("test_mystery_guest", T, "test_quality", "TEST_SMELL_005", prefix=TESTS_AT)
issue_query("test_general_fixture", T, "test_quality", "TEST_SMELL_006", prefix=TESTS_AT)


@query(f"SELECT {KEY} AS file_id, CAST({total(T, 'tests')} AS BIGINT) AS tests, CAST({total(T, 'assertions')} AS DOUBLE) AS assertions, CAST({total(T, 'weak_assertions')} AS DOUBLE) AS weak FROM part WHERE {total(T, 'tests')} > 0")
def test_assertion_classes(spark, d):
    rows = engine.scoped_measures(facts(spark, d, T, "test_quality", TESTS_AT), "assertions", "weak_assertions")
    return rows.groupBy("file_id").agg(F.count("*").alias("tests"), F.sum("assertions").alias("assertions"), F.sum("weak_assertions").alias("weak"))


#: The kinds of the nodes of the two tests of one piece, breadth first
SHAPES = ("FunctionDefargumentsAssertCallNameConstantLoad", "FunctionDefargumentsAssertargCallAttributeConstantNameLoadLoad")


@query(f"""SELECT {KEY} AS file_id, round(CASE WHEN p_partkey % {len(T)} = 7 THEN (SELECT CAST(sum(CASE WHEN substr('{SHAPES[0]}', CAST(i AS INTEGER), 1) = substr('{SHAPES[1]}', CAST(i AS INTEGER), 1) THEN 1 ELSE 0 END) AS DOUBLE)
 FROM range(1, {min(map(len, SHAPES))} + 1) r(i)) / {max(map(len, SHAPES))} ELSE 0.0 END, 9) AS duplication FROM part""")
def test_duplication(spark, d):
    return engine.file_measures(facts(spark, d, disjoint(T), "test_quality", TESTS_AT), "duplication").withColumn("duplication", F.round("duplication", 9))


@query(f"SELECT rule_id, count(*) AS n FROM ({found_sql(T, lambda r: r.startswith('TEST_SMELL_') and r != 'TEST_SMELL_007')}) GROUP BY 1")
def test_smell_ranking(spark, d):
    return project.ranked_smells(facts(spark, d, T, "test_quality", TESTS_AT).filter("name <> 'TEST_SMELL_007'"))


@query("""SELECT p_brand AS project, 'critical' AS severity FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 40 = 7 OR p_partkey % 60 = 11) = 0""")
def test_files_missing(spark, d):
    """Projects without a test file, of all brands."""
    from ..operators.quality import projects_without_tests

    p = F.col("p_partkey")
    path = F.when(p % 40 == 7, "tests/check.py").when(p % 60 == 11, "src/shape_test.py").when(p % 3 == 0, "src/contest.py").otherwise("src/latest/x.py")
    return projects_without_tests(table(spark, d, "part").select(F.col("p_brand").alias("project"), path.alias("path")))


# --- cognitive load -----------------------------------------------------------------------------------------------

N = disjoint(pieces.NAMES)
SCORE_COLUMNS = ("logical_lines", "cognitive", "comment_score", "line_score", "structure_score", "documentation_score", "public_entities", "documented_entities")


def _pick(values):
    return f"list_value({', '.join(map(str, values))})[CAST(p_partkey % {len(N)} + 1 AS INTEGER)]"


NAMED = "(SELECT p_partkey, " + ", ".join(f"CAST({_pick([k[j] for k in pieces.IDENTIFIERS])} AS DOUBLE) AS {c}" for j, c in enumerate(("good", "poor", "wrong", "n", "distinct_names", "cc"))) + ", " + ", ".join(f"CAST({total(N, m)} AS DOUBLE) AS {m}" for m in SCORE_COLUMNS) + " FROM part)"
LOAD = f"""(SELECT *, CASE WHEN n = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, 50 + (10 * good - 10 * poor - 15 * wrong) / n * 5)) END AS identifier_quality, log2(distinct_names) AS identifier_entropy,
 CASE WHEN logical_lines = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, (171 - 5.2 * ln(3 * logical_lines) - 0.23 * cc - 16.2 * ln(logical_lines)) / 171 * 100)) END AS maintainability FROM {NAMED})"""
LOADED = f"(SELECT *, 0.4 * identifier_quality + 0.2 * comment_score + 0.15 * line_score + 0.15 * structure_score + 0.1 * documentation_score AS readability FROM {LOAD})"
LOAD_COLUMNS = ("identifier_quality", "identifier_entropy", "maintainability", "readability", *SCORE_COLUMNS)


@query(f"SELECT {KEY} AS file_id, {', '.join(f'round({c}, 6) AS {c}' for c in LOAD_COLUMNS)} FROM {LOADED}")
def cognitive_measures(spark, d):
    found = engine.file_measures(facts(spark, d, N, "cognitive_load"), *LOAD_COLUMNS)
    return found.select("file_id", *(F.round(c, 6).alias(c) for c in LOAD_COLUMNS))


LOAD_ISSUES = " UNION ALL ".join(
    file_issue(rule, f"CASE WHEN {bad} THEN 'high' ELSE '{severity}' END", f"'{title} in m' || p_partkey || '.py'", where, LOADED, "NULL")
    for rule, severity, bad, title, where in (
        ("COGN-NAMING", "medium", "identifier_quality <= 40", "Poor identifier quality", "identifier_quality < 60"),
        ("COGN-MI", "medium", "maintainability <= 40", "Low maintainability index", "maintainability < 65"),
        ("COGN-COMPLEXITY", "medium", "cognitive > 25", "High cognitive complexity", "cognitive > 15"),
        ("COGN-READABILITY", "medium", "readability <= 50", "Low readability", "readability < 70"),
        ("COGN-DOC", "low", "false", "No documentation", "public_entities > 0 AND documented_entities = 0"),
    )
)


@query(LOAD_ISSUES)
def cognitive_issues(spark, d):
    return engine.issues(facts(spark, d, N, "cognitive_load")).select(*ISSUE)


@query(f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([{{'kind': 'good', 'n': good}}, {{'kind': 'meaningless', 'n': poor}}, {{'kind': 'misleading', 'n': wrong}}, {{'kind': 'plain', 'n': n - good - poor - wrong}}], recursive := true) FROM {NAMED}) GROUP BY 1")
def identifier_kinds(spark, d):
    found = facts(spark, d, N, "cognitive_load").filter("kind = 'identifier'")
    return found.groupBy(F.col("detail").alias("kind")).agg(F.sum("value").cast("long").alias("n"))


# --- complexity ---------------------------------------------------------------------------------------------------

C = pieces.COMPLEXITY
STRUCTURED = "(" + " + ".join(f"CASE WHEN {p.here} THEN {b[0]} ELSE 0 END" for p, b in zip(C, pieces.BLOCKS)) + ")"


def _blocks():
    out, before = [], ["0"]
    null = lambda v: "NULL" if v is None else v
    for p, (_, blocks) in zip(C, pieces.BLOCKS):
        for name, line, cc, cognitive, npath in blocks:
            out.append(f"SELECT {KEY} AS file_id, '{name}' AS scope, CAST({' + '.join(before)} + {line} AS INTEGER) AS line_number, CAST({cc} AS DOUBLE) AS cyclomatic, CAST(greatest(1, {cc} - {STRUCTURED} + 1) AS DOUBLE) AS essential, CAST({null(cognitive)} AS DOUBLE) AS cognitive, CAST({null(npath)} AS DOUBLE) AS npath FROM part WHERE {p.here}")
        before.append(f"CASE WHEN {p.here} THEN {p.code.count(chr(10))} ELSE 0 END")
    return "(" + " UNION ALL ".join(out) + ")"


BLOCKS = _blocks()


@query(f"SELECT * FROM {BLOCKS}")
def complexity_blocks(spark, d):
    return engine.scoped_measures(facts(spark, d, C, "complexity"), "cyclomatic", "essential", "cognitive", "npath")


DEEP = total(C, "nesting", "max")


@query(f"SELECT {KEY} AS file_id, CAST({DEEP} AS DOUBLE) AS nesting FROM part")
def complexity_nesting(spark, d):
    return engine.file_measures(facts(spark, d, C, "complexity"), "nesting")


def _block_issue(rule, severity, title, where):
    return f"SELECT file_id, '{rule}' AS rule_id, {severity} AS severity, '{title} in ''' || scope || '''' AS title, line_number FROM {BLOCKS} WHERE {where}"


@query(" UNION ALL ".join((
    _block_issue("COMPLEXITY001", "CASE WHEN cyclomatic > 20 THEN 'high' ELSE 'medium' END", "High cyclomatic complexity", "cyclomatic > 10"),
    _block_issue("COMPLEXITY003", "CASE WHEN cognitive > 30 THEN 'high' ELSE 'medium' END", "High cognitive complexity", "cognitive > 15"),
    _block_issue("COMPLEXITY006", "'medium'", "High essential complexity", "essential > 4"),
    _block_issue("COMPLEXITY009", "'high'", "Excessive execution paths", "npath > 200"),
    file_issue("COMPLEXITY005", f"CASE WHEN {DEEP} > 6 THEN 'high' ELSE 'medium' END", "'Excessive nesting depth in m' || p_partkey || '.py'", f"{DEEP} > 4", line="NULL"),
)))
def complexity_issues(spark, d):
    own = engine.issues(facts(spark, d, C, "complexity"))
    return own.filter(F.col("rule_id").isin("COMPLEXITY001", "COMPLEXITY003", "COMPLEXITY005", "COMPLEXITY006", "COMPLEXITY009")).select(*ISSUE)


COUNTED = "(SELECT p_partkey, " + ", ".join(f"CAST(list_value({', '.join(str(h[k]) for h in pieces.HALSTEAD)})[CAST(p_partkey % {len(C)} + 1 AS INTEGER)] AS DOUBLE) AS {c}" for k, c in enumerate(("h1", "h2", "n1", "n2"))) + " FROM part)"
HALSTEAD = f"(SELECT p_partkey, v AS volume, f AS difficulty, v * f AS effort, v * f / 18 AS time, v / 3000 AS bugs FROM (SELECT *, CASE WHEN h1 + h2 > 0 THEN (n1 + n2) * log2(h1 + h2) ELSE 0.0 END AS v, CASE WHEN h2 > 0 THEN h1 / 2 * n2 / h2 ELSE 0.0 END AS f FROM {COUNTED}))"
MEASURES = ("volume", "difficulty", "effort", "time", "bugs")


@query(f"SELECT {KEY} AS file_id, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM {HALSTEAD}")
def halstead_of_code(spark, d):
    found = engine.file_measures(facts(spark, d, disjoint(C), "complexity"), *(f"halstead_{m}" for m in MEASURES))
    return found.select("file_id", *(F.round(f"halstead_{m}", 6).alias(m) for m in MEASURES))


# --- rules --------------------------------------------------------------------------------------------------------

RULES = [
    rules.Rule.load(r)
    for r in (
        {"id": "calls", "name": "No eval", "severity": "CRITICAL", "pattern": "eval(", "patterns-not": ["safe("]},
        {"id": "either", "name": "Logged", "severity": "low", "patterns-any": ["print(", "write("], "requires": ["logging"]},
        {"id": "both", "name": "Both", "severity": "odd", "patterns-all": ["dump", "dumps(x)"]},
        {"id": "text", "name": "To do", "severity": "info", "type": "regex", "pattern": r"# (TODO|FIXME): (\w+)", "excludes": ["later"], "message": "$CAPTURE1 for $CAPTURE2"},
        {"id": "bad", "name": "Bad", "type": "regex", "pattern": "("},
        {"id": "shape", "name": "Compared with itself", "severity": "high", "type": "structure", "pattern": "$X == $X", "message": "$X"},
        {"id": "call", "name": "Shell", "severity": "high", "type": "structure", "pattern": "$F(..., shell=True)"},
        {"id": "god", "name": "Long", "severity": "medium", "type": "smell", "pattern": "god function"},
        {"id": "magic", "name": "Magic", "severity": "low", "type": "smell", "pattern": "magic number"},
        {"id": "params", "name": "Parameters", "severity": "medium", "type": "smell", "pattern": "too many params"},
        {"id": "dead", "name": "Dead", "severity": "low", "type": "smell", "pattern": "dead code"},
        {"id": "flow", "name": "Flow", "severity": "high", "type": "taint", "sources": ["fetch"], "sinks": ["store"], "exclude-paths": ["never/"]},
        {"id": "off", "name": "Off", "pattern": "eval(", "enabled": False},
        {"id": "elsewhere", "name": "Elsewhere", "pattern": "eval(", "exclude_paths": ["src/"]},
    )
]
CODE_TAINT = "Security: Untrusted Data Flow"
RULED = [
    mosaic.Piece(1, 0, "import json\n"),
    mosaic.Piece(2, 0, "eval(text)\nsafe(text)\nresult = eval(text)\nnote = 'use EVAL( here'\n", (("calls", "critical", "No eval", 1), ("calls", "critical", "No eval", 3), ("calls", "critical", "No eval", 3), ("calls", "critical", "No eval", 4))),
    mosaic.Piece(3, 0, "import logging\nprint(text)\nfile.write(text)\n", (("either", "low", "Logged", 2), ("either", "low", "Logged", 3))),
    mosaic.Piece(4, 1, "json.dump(text)\njson.dumps(text)\nnote = 'dumps(x)'\n", (("both", "medium", "Both", 1), ("both", "medium", "Both", 3))),
    mosaic.Piece(3, 1, "# TODO: tidy\n# TODO: later\n# FIXME: mend # TODO: twice\n", (("text", "info", "To do", 1), ("text", "info", "To do", 3))),
    mosaic.Piece(5, 0, "same = a.b == a.b\nother = a.b == a.c\ngo(a, shell=True)\ngo(shell=False)\n", (("shape", "high", "Compared with itself", 1), ("call", "high", "Shell", 3))),
    mosaic.Piece(5, 1, "size = 42\nsmall = -1 + 10\nflag = True\nhalf = 0.5\n", (("magic", "low", "Code Smell: Magic", 1), ("magic", "low", "Code Smell: Magic", 4))),
    mosaic.Piece(4, 3, "def many(a, b, c, *, d, e, **f):\n    return a\n    b = c\nasync def stop():\n    raise a\n    pass\n", (("params", "medium", "Code Smell: Parameters", 1), ("dead", "low", "Code Smell: Dead", 3), ("dead", "low", "Code Smell: Dead", 6))),
    mosaic.Piece(7, 0, "def tall():\n" + "    go()\n" * 51, (("god", "medium", "Code Smell: Long", 1),)),
    mosaic.Piece(7, 1, "asked = input()\nexec(asked)\nmine = fetch()\nbase.store(mine)\ncompile(read())\n", (
        ("flow", "high", "Taint Flow: Flow", 2), ("flow", "high", "Taint Flow: Flow", 4), ("flow", "high", "Taint Flow: Flow", 5), ("TAINT001", "high", CODE_TAINT, 2), ("TAINT001", "medium", CODE_TAINT, 5))),
    mosaic.Piece(6, 5, "".join(f"def {n}{k}(a{', b' if n == 'two' else ''}):\n    {'return a' if n != 'three' else 'pass'}\n" for n in ("one", "two", "three") for k in (1, 2)), (("SMELL001", "low", "Code Smell: Possible Code Duplication", 0),)),
]


def rule_facts(spark, d):
    return engine.facts(mosaic.files(spark, d, RULED), extra={"custom_rules": rules.detector(RULES)})


@query(found_sql(RULED))
def rule_issues(spark, d):
    return engine.issues(rule_facts(spark, d)).select(*ISSUE)


@query(f"SELECT r.rule_id, count(i.rule_id) AS violations FROM (VALUES {', '.join(f'({chr(39)}{r.id}{chr(39)})' for r in RULES if r.enabled)}) r(rule_id) LEFT JOIN ({found_sql(RULED)}) i USING (rule_id) GROUP BY 1")
def rule_counts(spark, d):
    from ..operators.rules import counts

    listed = spark.createDataFrame([(r.id,) for r in RULES if r.enabled], "rule_id string")
    return counts(engine.issues(rule_facts(spark, d)), listed)


@query(f"""SELECT file_id, 'text' AS rule_id, line_number, CASE WHEN n % 2 = 1 THEN 'TODO for tidy' ELSE 'FIXME for mend' END AS message
 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS n FROM ({found_sql(RULED, lambda r: r == 'text')}))
 UNION ALL SELECT file_id, 'shape', line_number, 'a.b' FROM ({found_sql(RULED, lambda r: r == 'shape')})""")
def rule_captures(spark, d):
    own = engine.issues(rule_facts(spark, d)).filter("rule_id in ('text', 'shape')")
    return own.select("file_id", "rule_id", "line_number", F.col("detail").alias("message"))


# --- project metrics and insights ---------------------------------------------------------------------------------


def _count(rule=None, severity=None):
    where = [f"starts_with(rule_id, '{rule}')"] * bool(rule) + [f"severity = '{severity}'"] * bool(severity)
    return f"CAST(count(*) FILTER ({' AND '.join(where) or 'true'}) AS DOUBLE)"


STYLE_ISSUES = f"(SELECT * FROM ({found_sql(S)}) UNION ALL ({COVERAGE_SQL}) UNION ALL ({LINE_SQL}))"
EDGE_ISSUES = f"(SELECT * FROM ({found_sql(E, lambda r: r != 'EDGE_OVF001')}) UNION ALL {CAPPED} UNION ALL {file_issue('EDGE_EP001', chr(39) + 'low' + chr(39), chr(39) + 'x' + chr(39), total(E, 'missing_else') + ' > 3', line='NULL')})"
WIDE = {
    "security": f"""SELECT {_count()} AS total_vulnerabilities, {_count(severity='critical')} AS critical_severity, {_count(severity='high')} AS high_severity, {_count(severity='medium')} AS medium_severity,
 least(100.0, 10 * {_count(severity='critical')} + 5 * {_count(severity='high')} + 2 * {_count(severity='medium')} + {_count(severity='low')}) AS risk_score, {_count('TAINT_')} AS taint_flows_detected, {_count('SECRET_')} AS secrets_exposed,
 {_count('CRYPTO_')} AS crypto_vulnerabilities, {_count('CWE-')} AS injection_vulnerabilities, CAST(count(DISTINCT {_case(security.OWASP, 'rule_id')}) AS DOUBLE) AS owasp_categories_affected, CAST(count(DISTINCT {_case(security.CWE, 'rule_id')}) AS DOUBLE) AS cwe_types_detected
 FROM ({found_sql(pieces.SECURITY)})""",
    "style": f"""SELECT n AS total_violations, names AS naming_violations, wide AS consistency_issues, CAST(lines AS DOUBLE) AS total_lines, 1000 * n / lines AS violations_per_kloc, 100.0 * fd / f AS docstring_coverage, 100.0 * h / f AS type_hint_coverage, CAST(files AS DOUBLE) AS files_analyzed
 FROM (SELECT {_count()} AS n, {_count('PEP8_NAMING_')} AS names, {_count('PEP8_LINE')} + {_count('PEP8_TRAILING')} AS wide FROM {STYLE_ISSUES}), (SELECT sum(f) AS f, sum(fd) AS fd, sum(h) AS h, count(*) AS files FROM {RATES}), (SELECT sum({line_total(S)}) AS lines FROM part)""",
    "architecture": f"""SELECT l AS average_lcom, b AS average_cbo, r AS average_rfc, w AS average_wmc, a AS abstractness, s AS solid_violations, m AS architectural_smells FROM (SELECT avg({LCOM}) AS l, avg(cbo) AS b, avg(rfc) AS r, avg(wmc) AS w, CAST(sum(abstract_methods) AS DOUBLE) / sum(classes) AS a FROM {MODULES}),
 (SELECT {_count('SOLID-')} AS s, {_count('SMELL-')} AS m FROM ({found_sql(A)}))""",
    "edge_cases": f"""SELECT t AS total_edge_case_issues, b AS boundary_value_issues, v AS validation_gaps, o AS off_by_one_errors, u AS null_handling_issues, w AS overflow_risks, CAST(f AS DOUBLE) AS functions_analyzed
 FROM (SELECT {_count()} AS t, {_count('EDGE_BVA001')} AS b, {_count('EDGE_VAL001')} + {_count('EDGE_BVA002')} AS v, {_count('EDGE_OBOE001')} AS o, {_count('EDGE_NULL001')} AS u, {_count('EDGE_OVF')} AS w FROM {EDGE_ISSUES}), (SELECT sum({total(E, 'functions')}) AS f FROM part)""",
    "cognitive_load": f"""SELECT round(m, 2) AS average_maintainability_index, round(r, 2) AS average_readability_score, round(c, 2) AS average_cognitive_complexity, round(q, 2) AS identifier_quality_score, round(e, 3) AS average_identifier_entropy, round(100.0 * x / p, 1) AS documentation_coverage,
 CAST(lm AS DOUBLE) AS low_mi_files, CAST(lr AS DOUBLE) AS low_readability_files, CAST(hc AS DOUBLE) AS high_complexity_files FROM (SELECT avg(maintainability) AS m, avg(readability) AS r, avg(cognitive) AS c, avg(identifier_quality) AS q, avg(identifier_entropy) AS e, sum(documented_entities) AS x, sum(public_entities) AS p,
 count(*) FILTER (maintainability < 65) AS lm, count(*) FILTER (readability < 70) AS lr, count(*) FILTER (cognitive > 15) AS hc FROM {LOADED})""",
    "complexity": f"""SELECT avg(cyclomatic) AS average_cyclomatic_complexity, max(cyclomatic) AS max_cyclomatic_complexity, sum(cognitive) / count(*) AS average_cognitive_complexity, max(cognitive) AS max_cognitive_complexity, avg(essential) AS average_essential_complexity,
 sum(npath) / count(*) AS average_npath_complexity, max(npath) AS max_npath_complexity, CAST(count(*) AS DOUBLE) AS total_functions, (SELECT CAST(max({DEEP}) AS DOUBLE) FROM part) AS max_nesting_depth FROM {BLOCKS}""",
    "custom_rules": f"SELECT {_count()} AS total_violations, {_count('TAINT001')} AS taint_flows_detected, {_count('SMELL001')} AS code_smells_detected FROM ({found_sql(RULED)})",
}
#: An expression per metric, but for those of Halstead over a mosaic, which no closed form gives
NAMES_OF = {
    "security": ("total_vulnerabilities", "critical_severity", "high_severity", "medium_severity", "risk_score", "taint_flows_detected", "secrets_exposed", "crypto_vulnerabilities", "injection_vulnerabilities", "owasp_categories_affected", "cwe_types_detected"),
    "style": ("total_violations", "naming_violations", "consistency_issues", "total_lines", "violations_per_kloc", "docstring_coverage", "type_hint_coverage", "files_analyzed"),
    "architecture": ("average_lcom", "average_cbo", "average_rfc", "average_wmc", "abstractness", "solid_violations", "architectural_smells"),
    "edge_cases": ("total_edge_case_issues", "boundary_value_issues", "validation_gaps", "off_by_one_errors", "null_handling_issues", "overflow_risks", "functions_analyzed"),
    "cognitive_load": ("average_maintainability_index", "average_readability_score", "average_cognitive_complexity", "identifier_quality_score", "average_identifier_entropy", "documentation_coverage", "low_mi_files", "low_readability_files", "high_complexity_files"),
    "complexity": ("average_cyclomatic_complexity", "max_cyclomatic_complexity", "average_cognitive_complexity", "max_cognitive_complexity", "average_essential_complexity", "average_npath_complexity", "max_npath_complexity", "total_functions", "max_nesting_depth"),
    "custom_rules": ("total_violations", "taint_flows_detected", "code_smells_detected"),
}


def analyzer_facts(spark, d, analyzer):
    parts = {"security": pieces.SECURITY, "style": S, "architecture": A, "edge_cases": E, "cognitive_load": N, "complexity": C}
    if analyzer == "custom_rules":
        return rule_facts(spark, d)
    found = facts(spark, d, parts[analyzer], analyzer)
    return found.filter("name <> 'PEP8_NAMING_NAMING_SIMILAR'")  # structure.similar_names has a query of its own


def _metrics_sql(analyzer):
    out = []
    for name in NAMES_OF[analyzer]:
        limit, higher = project.LIMITS.get(name, (None, False))
        limit = "CAST(NULL AS DOUBLE)" if limit is None else f"CAST({limit} AS DOUBLE)"
        out.append(f"SELECT '{analyzer}' AS analyzer, '{name}' AS name, round({name}, 6) AS value, {limit} AS threshold, {name} <= {limit} AS passed, {name} {'>=' if higher else '<='} {limit} AS intended FROM w")
    return f"WITH w AS ({WIDE[analyzer]}) " + " UNION ALL ".join(out)


def _register(analyzer):
    def metrics(spark, d):
        own = project.metrics(analyzer_facts(spark, d, analyzer), analyzer)
        return own.filter(F.col("name").isin(*NAMES_OF[analyzer])).withColumn("value", F.round("value", 6))

    metrics.__name__ = f"{analyzer}_metrics"
    query(_metrics_sql(analyzer))(metrics)
    if analyzer == "complexity":  # three of its insights need Halstead's measures
        return

    def said(spark, d):
        own = project.insights(project.wide_metrics(analyzer_facts(spark, d, analyzer), analyzer), analyzer)
        return own.select("analyzer", F.array_join("insights", " | ").alias("insights"))

    said.__name__ = f"{analyzer}_insights"
    limit = project.MOST_INSIGHTS.get(analyzer, 99)
    listed = f"list_filter([{', '.join(project.insight_sql(analyzer, 'printf'))}], lambda x: x IS NOT NULL)[1:{limit}]"
    query(f"WITH w AS ({WIDE[analyzer]}) SELECT '{analyzer}' AS analyzer, array_to_string({listed}, ' | ') AS insights FROM w")(said)


for _analyzer in WIDE:
    _register(_analyzer)

