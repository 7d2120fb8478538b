"""The engine's queries on the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import findings, graph, rules, scoring, structure, text_metrics
from ..schema import CATEGORIES, GRADES, PENALTY, RISK, SEVERITIES, WEIGHTS, grade
from ..sources import pyast
from ..sources.tables import documents_as_files, events_as_issues, lines, spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _case(values: dict, column: str, default) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


RANK = _case({s: k for k, s in enumerate(SEVERITIES)}, "severity", 5)
ISSUES = """(SELECT CASE user_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style' ELSE 'complexity' END AS category,
 CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
 event_type AS title, CAST(user_id AS VARCHAR) AS file_path, CAST(hour(ts) AS INTEGER) AS line_number, event_id AS emit_seq FROM events)"""
LINES = "(SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
CODE = "(SELECT CAST(p_partkey AS VARCHAR) AS file_id, p_size % 7 AS d, p_size % 12 AS n, p_size % 13 AS k FROM part)"
#: Who delivers to whom. The first ten nations are one module each and import one another; the others are two, one that is
#: delivered to and one that delivers, so no way leads back from them
EDGES = """(SELECT DISTINCT CASE WHEN c_nationkey < 10 THEN c_nationkey ELSE 100 + c_nationkey END AS src, CASE WHEN s_nationkey < 10 THEN s_nationkey ELSE 200 + s_nationkey END AS dst
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""
TOKENS = "(SELECT file_id, token FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents))"


# --- findings -----------------------------------------------------------------------------------------------------


@query(f"SELECT s.severity, count(i.severity) AS n FROM (VALUES {', '.join(f'({s!r})' for s in SEVERITIES)}) s(severity) LEFT JOIN {ISSUES} i USING (severity) GROUP BY s.severity")
def issue_severity_counts(spark, d):
    return findings.by_severity(events_as_issues(spark, d))


@query(f"SELECT s.category, count(i.category) AS n FROM (VALUES {', '.join(f'({s!r})' for s in CATEGORIES)}) s(category) LEFT JOIN {ISSUES} i USING (category) GROUP BY s.category")
def issue_group_all_keys(spark, d):
    return findings.by_category(events_as_issues(spark, d))


@query(f"SELECT severity, category, title, file_path, line_number, min(emit_seq) AS emit_seq FROM {ISSUES} GROUP BY ALL")
def issue_dedup_first(spark, d):
    return findings.dedup(events_as_issues(spark, d)).select(*findings.KEYS, "emit_seq")


@query(f"SELECT severity, title, file_path, emit_seq, CAST({RANK} AS INTEGER) AS severity_rank FROM {ISSUES} ORDER BY severity_rank, emit_seq LIMIT 10")
def issue_top_n(spark, d):
    return findings.top_n(events_as_issues(spark, d)).select("severity", "title", "file_path", "emit_seq", "severity_rank")


@query(f"SELECT file_path, emit_seq, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY emit_seq) AS place FROM {ISSUES}) WHERE place <= 5")
def issue_cap_per_group(spark, d):
    return findings.cap(events_as_issues(spark, d), "file_path", 5).select("file_path", "emit_seq", "place")


@query(f"SELECT severity, n, 100.0 * n / sum(n) OVER () AS pct, CAST(floor(100.0 * n / sum(n) OVER () / 2.5) AS INTEGER) AS bar FROM (SELECT severity, count(*) AS n FROM {ISSUES} GROUP BY severity)")
def severity_share(spark, d):
    return findings.severity_share(events_as_issues(spark, d))


@query(f"SELECT file_path, severity, title, emit_seq FROM {ISSUES} WHERE severity IN ('critical', 'high')")
def issue_filter_severe(spark, d):
    return events_as_issues(spark, d).filter(F.col("severity").isin("critical", "high")).select("file_path", "severity", "title", "emit_seq")


# --- scoring ------------------------------------------------------------------------------------------------------

PEN, RIS = _case(PENALTY, "severity", 0.0), _case(RISK, "severity", 0)
#: Metrics of three analyzers from order totals: value, threshold, observed pass.
METRICS = """(SELECT analyzer, name, value_num, threshold, value_num <= threshold AS passed FROM (
 SELECT CASE o_custkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style' ELSE 'architecture' END AS analyzer, CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS value_num,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 100000.0 END AS threshold FROM orders))"""
SCORES = f"""(SELECT coalesce(i.analyzer, m.analyzer) AS analyzer, 0.7 * coalesce(ratio, 1.0) + 0.3 * (1 - coalesce(penalty, 0)) AS score_7030,
 coalesce(ratio, greatest(0.0, 1 - coalesce(engine_penalty, 0))) AS score_observed
 FROM (SELECT category AS analyzer, least(1.0, sum(CAST({PEN} AS DOUBLE))) AS penalty, least(1.0, sum(CAST(CASE WHEN severity = 'info' THEN 0.0 ELSE {PEN} END AS DOUBLE))) AS engine_penalty FROM {ISSUES} GROUP BY 1) i
 FULL JOIN (SELECT analyzer, avg(CAST(passed AS DOUBLE)) AS ratio FROM {METRICS} GROUP BY 1) m ON i.analyzer = m.analyzer)"""
WEIGHT = _case(WEIGHTS, "analyzer", 0.0)


def _metrics(spark, d):
    o = table(spark, d, "orders")
    analyzer = F.when(F.col("o_custkey") % 3 == 0, "security").when(F.col("o_custkey") % 3 == 1, "style").otherwise("architecture")
    threshold = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.lit(100000.0))
    return o.select(analyzer.alias("analyzer"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("value_num"), threshold.alias("threshold")).withColumn("passed", scoring.passed(F.col("value_num"), F.col("threshold")))


@query(f"SELECT category AS analyzer, least(1.0, sum(CAST({PEN} AS DOUBLE))) AS penalty, CAST(least(100, sum({RIS})) AS BIGINT) AS risk FROM {ISSUES} GROUP BY 1")
def analyzer_penalty(spark, d):
    return scoring.penalties(events_as_issues(spark, d)).select("analyzer", "penalty", "risk")


@query(f"SELECT analyzer, name, value_num, threshold, passed FROM {METRICS}")
def metric_threshold_pass(spark, d):
    return _metrics(spark, d)


@query(f"SELECT analyzer, avg(CAST(passed AS DOUBLE)) AS ratio FROM {METRICS} GROUP BY 1")
def pass_ratio(spark, d):
    return scoring.pass_ratio(_metrics(spark, d))


@query(f"SELECT analyzer, round(score_7030, 9) AS score_7030, round(score_observed, 9) AS score_observed FROM {SCORES}")
def analyzer_scores(spark, d):
    return scoring.analyzer_scores(events_as_issues(spark, d), _metrics(spark, d)).select("analyzer", F.round("score_7030", 9).alias("score_7030"), F.round("score_observed", 9).alias("score_observed"))


GRADE = "CASE " + " ".join(f"WHEN score >= {x} THEN '{g}'" for g, x in GRADES) + " ELSE 'F' END"


@query(f"SELECT round(score, 6) AS score, {GRADE} AS grade FROM (SELECT greatest(0.0, least(100.0, sum(score_observed * CAST({WEIGHT} AS DOUBLE)) / sum(CAST({WEIGHT} AS DOUBLE)) * 100)) AS score FROM {SCORES})")
def overall_score(spark, d):
    return scoring.overall(scoring.analyzer_scores(events_as_issues(spark, d), _metrics(spark, d))).select(F.round("score", 6).alias("score"), "grade")


@query(f"SELECT c_custkey, score, {GRADE} AS grade FROM (SELECT c_custkey, c_acctbal / 100 AS score FROM customer)")
def grade_lookup(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("score")).withColumn("grade", grade(F.col("score")))


# --- lines and text -----------------------------------------------------------------------------------------------

CONSISTENCY = f"""(SELECT file_id, count(*) AS n_lines, count(*) FILTER (length(line) > 88) AS over_88, count(*) FILTER (length(line) > 120) AS over_120,
 count(*) FILTER (regexp_matches(line, '[ \\t]$')) AS trailing, count(*) FILTER (regexp_matches(line, '^\\s*#')) AS comments, count(*) FILTER (regexp_matches(line, '\\S')) AS filled,
 avg(length(regexp_replace(line, '\\s+$', ''))) FILTER (regexp_matches(line, '\\S')) AS mean_length FROM {LINES} GROUP BY 1)"""


@query(f"SELECT * FROM {CONSISTENCY}")
def line_consistency(spark, d):
    return text_metrics.line_consistency(lines(documents_as_files(spark, d)))


@query(f"""SELECT file_id, CASE WHEN mean_length IS NULL OR mean_length BETWEEN 40 AND 80 THEN 100 WHEN mean_length BETWEEN 30 AND 100 THEN 80 WHEN mean_length BETWEEN 20 AND 120 THEN 60 ELSE 40 END AS length_score,
 CASE WHEN filled = 0 OR comments / filled < 0.05 THEN 50 WHEN comments / filled < 0.1 THEN 80 WHEN comments / filled <= 0.2 THEN 100 WHEN comments / filled <= 0.3 THEN 70 ELSE 40 END AS comment_score FROM {CONSISTENCY}""")
def readability_bands(spark, d):
    c = text_metrics.line_consistency(lines(documents_as_files(spark, d)))
    return c.select("file_id", text_metrics.length_band(F.col("mean_length")).alias("length_score"), text_metrics.density_band(F.col("comments"), F.col("filled")).alias("comment_score"))


@query(f"SELECT sum(n_lines) AS n_lines, 1000.0 * sum(over_120) / sum(n_lines) AS per_kloc, 100.0 * (1 - sum(over_88) / sum(n_lines)) AS compliance FROM {CONSISTENCY}")
def kloc_rates(spark, d):
    c = text_metrics.line_consistency(lines(documents_as_files(spark, d)))
    return c.agg(F.sum("n_lines").alias("n_lines"), (1000.0 * F.sum("over_120") / F.sum("n_lines")).alias("per_kloc"), (100.0 * (1 - F.sum("over_88") / F.sum("n_lines"))).alias("compliance"))


@query(f"SELECT file_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT file_id, token, count(*) AS c FROM {TOKENS} GROUP BY 1, 2) GROUP BY 1")
def identifier_entropy(spark, d):
    return text_metrics.entropy(_tokens(spark, d)).select("file_id", F.round("entropy", 6).alias("entropy"))


@query(f"""SELECT file_id, greatest(0.0, least(100.0, 50 + sum(CASE WHEN length(token) = 1 OR token IN ('tmp', 'temp', 'data', 'val', 'var', 'obj', 'foo', 'bar', 'baz') THEN -10 ELSE 10 END) / count(*) * 5)) AS score FROM {TOKENS} GROUP BY 1""")
def identifier_quality(spark, d):
    return text_metrics.name_quality(_tokens(spark, d))


def _tokens(spark, d):
    f = documents_as_files(spark, d)
    return f.select("file_id", F.explode(F.regexp_extract_all(F.lower("code"), F.lit("([a-z]+)"), F.lit(1))).alias("token"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents")
def file_hash(spark, d):
    return documents_as_files(spark, d).select("file_id", F.sha2("code", 256).alias("sha256"), F.octet_length("code").cast("long").alias("size_bytes"))


@query("SELECT signature, count(*) AS n FROM (SELECT md5(regexp_replace(coalesce(text, ''), '[a-z]+', 'x', 'g')) AS signature FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_signature(spark, d):
    s = documents_as_files(spark, d).select(F.md5(F.regexp_replace("code", "[a-z]+", "x")).alias("signature"))
    return s.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1")


# --- rules --------------------------------------------------------------------------------------------------------

RULES = [
    {"id": "R1", "severity": "high", "pattern": "token = ", "excludes": []},
    {"id": "R2", "severity": "low", "pattern": "[a-z]+ing the [a-z]+", "excludes": ["with"], "requires": ["the", "and"]},
    {"id": "R3", "severity": "info", "pattern": "^[A-Z][a-z]+\\.$", "excludes": ["Th"]},
    {"id": "R4", "severity": "info", "pattern": "nothing matches this", "requires": ["absent"]},
]
HITS = "(" + " UNION ALL ".join(
    f"SELECT '{r['id']}' AS rule_id, '{r['severity']}' AS severity, file_id, line, regexp_extract(line, '{r['pattern']}') AS hit FROM {LINES} WHERE regexp_matches(line, '{r['pattern']}')" + "".join(f" AND NOT contains(line, '{w}')" for w in r["excludes"] if r.get("excludes"))
    for r in [x | {"excludes": x.get("excludes", [])} for x in RULES]
) + ")"


@query(f"SELECT rule_id, severity, file_id, hit, count(*) AS n FROM {HITS} GROUP BY ALL")
def rule_regex_join(spark, d):
    return rules.regex_hits(lines(documents_as_files(spark, d)), RULES).groupBy("rule_id", "severity", "file_id", "hit").agg(F.count("*").alias("n"))


@query(f"SELECT r.rule_id, count(h.rule_id) AS violations FROM (VALUES ('R1'), ('R2'), ('R3'), ('R4')) r(rule_id) LEFT JOIN {HITS} h USING (rule_id) GROUP BY 1")
def per_rule_counts(spark, d):
    return rules.counts(rules.regex_hits(lines(documents_as_files(spark, d)), RULES), rules.rule_table(spark, RULES))


@query(f"""SELECT 'R2' AS rule_id, file_id FROM {TOKENS} WHERE token IN ('the', 'and') GROUP BY file_id HAVING count(DISTINCT token) = 2
 UNION ALL SELECT 'R1', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'R3', CAST(doc_id AS VARCHAR) FROM documents""")
def rule_requires_semi(spark, d):
    return rules.required(documents_as_files(spark, d), RULES)


# --- graph --------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    node = lambda c, role: F.when(F.col(c) < 10, F.col(c)).otherwise(role + F.col(c))
    return j.filter("c_nationkey <> s_nationkey").select(node("c_nationkey", 100).alias("src"), node("s_nationkey", 200).alias("dst")).distinct()


COUPLING = f"(SELECT node, CAST(sum(o) AS BIGINT) AS ce, CAST(sum(i) AS BIGINT) AS ca FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {EDGES} UNION ALL SELECT dst, 0, 1 FROM {EDGES}) GROUP BY 1)"


@query(f"SELECT node, ce, ca, ce / (ce + ca) AS instability FROM {COUPLING}")
def dep_coupling(spark, d):
    return graph.coupling(_edges(spark, d))


@query(f"SELECT round(avg(ce / (ce + ca)), 9) AS instability, round(abs(0.25 + avg(ce / (ce + ca)) - 1), 9) AS distance FROM {COUPLING}")
def dep_distance(spark, d):
    i = graph.coupling(_edges(spark, d)).agg(F.avg("instability").alias("i"))
    return i.select(F.round("i", 9).alias("instability"), F.round(F.abs(0.25 + F.col("i") - 1), 9).alias("distance"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
 SELECT a.src AS node, least(a.src, min(a.dst)) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def dep_cycles(spark, d):
    return graph.cycles(_edges(spark, d))


# --- JSON ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 50 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS score FROM events""")
def json_cascade(spark, d):
    p = F.col("props")
    kinds = [p, F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("```\n"), p, F.lit("\n```")), F.concat(F.lit("The answer: "), p, F.lit(" as asked")), F.replace(F.replace(p, F.lit('"'), F.lit("'")), F.lit("}"), F.lit(",}"))]
    text = kinds[4]
    for k in range(4):
        text = F.when(F.col("event_id") % 5 == k, kinds[k]).otherwise(text)
    out = table(spark, d, "events").select("event_id", jsonx.extract(text).alias("json"))
    return out.select("event_id", F.get_json_object("json", "$.k").cast("double").alias("k"), jsonx.score(F.col("json"), ("score", "k"), 0, 50).alias("score"))


# --- syntax trees: code is made from table rows; the SQL has the closed form --------------------------------------


def part_code(spark, d):
    """A function with p_size % 12 parameters and p_size % 7 nested ifs, and a class with p_size % 13 methods."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").cast("string").alias("file_id"), *((F.col("p_size") % m).alias(c) for c, m in (("d", 7), ("n", 12), ("k", 13))))
    many = lambda c, f: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(13)), lambda i: i < F.col(c)), f), "")
    args = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(13)), lambda i: i < F.col("n")), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")
    ifs = many("d", lambda i: F.concat(F.repeat(F.lit(" "), i + 1), F.lit("if flag > "), i.cast("string"), F.lit(":\n")))
    methods = many("k", lambda i: F.concat(F.lit(" def m"), i.cast("string"), F.lit("(self):\n  'doc'\n  return 1\n")))
    code = F.concat(F.lit("def work("), args, F.lit("):\n"), ifs, F.repeat(F.lit(" "), F.col("d") + 1), F.lit("return 1\nclass Box:\n 'doc'\n"), methods)
    return p.select("file_id", code.alias("code"))


@query(f"""SELECT file_id, 'work' AS func, CAST(d + 1 AS BIGINT) AS cyclomatic, CAST(d * (d + 1) / 2 AS BIGINT) AS cognitive, CAST(d AS BIGINT) AS nesting, CAST(n AS BIGINT) AS n_args, CAST(d AS BIGINT) AS n_ifs, CAST(d AS BIGINT) AS missing_else FROM {CODE}
 UNION ALL SELECT file_id, 'm' || CAST(unnest(range(k)) AS VARCHAR), 1, 0, 0, 1, 0, 0 FROM {CODE}""")
def ast_complexity(spark, d):
    return structure.functions(part_code(spark, d)).select("file_id", "func", "cyclomatic", "cognitive", "nesting", "n_args", "n_ifs", "missing_else")


@query(f"SELECT file_id, 'work' AS func, array_to_string(list_transform(range(n), lambda i: 'p' || i), ',') AS arguments FROM {CODE} UNION ALL SELECT file_id, 'm' || CAST(unnest(range(k)) AS VARCHAR), 'self' FROM {CODE}")
def ast_arguments(spark, d):
    return structure.functions(part_code(spark, d)).select("file_id", "func", F.array_join("arguments", ",").alias("arguments"))


@query(f"SELECT file_id, CASE WHEN d > 6 THEN 'high' ELSE 'medium' END AS severity, 'nesting' AS title FROM {CODE} WHERE d > 4 UNION ALL SELECT file_id, 'low', 'missing else' FROM {CODE} WHERE d > 3 UNION ALL SELECT file_id, 'medium', 'parameters' FROM {CODE} WHERE n > 5 UNION ALL SELECT file_id, 'high', 'methods' FROM {CODE} WHERE k > 10")
def ast_issues(spark, d):
    issue = lambda where, severity, title: F.when(F.expr(where), F.struct(severity.alias("severity"), F.lit(title).alias("title")))
    found = F.array_compact(F.array(
        issue("nesting > 4", F.when(F.col("nesting") > 6, "high").otherwise("medium"), "nesting"), issue("missing_else > 3", F.lit("low"), "missing else"),
        issue("n_args > 5", F.lit("medium"), "parameters"), issue("methods > 10", F.lit("high"), "methods"),
    ))
    return structure.blocks(part_code(spark, d)).select("file_id", F.explode(found).alias("i")).select("file_id", "i.*")


@query(f"SELECT file_id, CAST(k AS BIGINT) AS methods, CAST(k AS BIGINT) AS wmc FROM {CODE}")
def ast_classes(spark, d):
    return structure.classes(part_code(spark, d)).select("file_id", "methods", "wmc")


@query(f"SELECT file_id, 'work' AS func, CAST(1 + 2 * d AS DOUBLE) AS npath FROM {CODE} UNION ALL SELECT file_id, 'm' || CAST(unnest(range(k)) AS VARCHAR), 1 FROM {CODE}")
def ast_npath(spark, d):
    return structure.functions(part_code(spark, d)).select("file_id", "func", "npath")


@query(f"SELECT file_id, 'work' AS func, CAST(d + 1 AS BIGINT) AS simple FROM {CODE} UNION ALL SELECT file_id, 'm' || CAST(unnest(range(k)) AS VARCHAR), 1 FROM {CODE}")
def ast_simple_complexity(spark, d):
    return structure.functions(part_code(spark, d)).select("file_id", "func", "simple")


@query(f"SELECT file_id, 100.0 * (k + 1) / (k + 2) AS pct FROM {CODE}")
def ast_docstrings(spark, d):
    return structure.docstring_coverage(part_code(spark, d))


#: Nodes of each kind in one file
KINDS = {"Module": "1", "FunctionDef": "1 + k", "arguments": "1 + k", "arg": "n + k", "If": "d", "Compare": "d", "Name": "d", "Load": "d", "Gt": "d", "Constant": "d + 2 + 2 * k", "Return": "1 + k", "ClassDef": "1", "Expr": "1 + k"}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST(sum({n}) AS BIGINT) AS n FROM {CODE}" for kind, n in KINDS.items()))
def ast_histogram(spark, d):
    return structure.histogram(part_code(spark, d))


@query(f"SELECT file_id, CAST(max_depth AS INTEGER) AS block_nest FROM (SELECT file_id, d AS max_depth FROM {CODE})")
def ast_nodes_nesting(spark, d):
    tree = pyast.nodes(part_code(spark, d))
    inside = F.col("block_nest") + F.col("kind").isin("If", "For", "While", "With", "Try").cast("int")
    return tree.groupBy("file_id").agg(F.max(inside).alias("block_nest"))


@query("""WITH w AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id, event_type || CAST(hour(ts) AS VARCHAR) AS name FROM events)
 SELECT file_id, a, b FROM (SELECT x.file_id, x.name AS a, y.name AS b, row_number() OVER (PARTITION BY x.file_id ORDER BY x.name, y.name) AS r FROM w x JOIN w y ON x.file_id = y.file_id AND x.name < y.name
 WHERE levenshtein(x.name, y.name) <= least(length(x.name), length(y.name)) // 3) WHERE r <= 5""")
def name_similarity_pairs(spark, d):
    names = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_id"), F.concat("event_type", F.hour("ts").cast("string")).alias("name"))
    return structure.similar_names(names)
