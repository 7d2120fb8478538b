"""Queries on results, reports, validation, caches, answers and rewriting, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render, responses, results, rewrite, scoring
from ..schema import CATEGORIES, GRADES, SEVERITIES
from ..sources.tables import documents_as_files, events_as_issues, table
from . import detectors, pieces
from .detectors import BLOCKS, MODULES, NAMED
from .mosaic import files as mosaic_files
from .mosaic import found_sql, line_total
from .queries import ISSUES, METRICS, RANK, SCORES, WEIGHT, _metrics, query

# --- selections and groups ------------------------------------------------------------------------------------------


@query(f"SELECT file_path, severity, category, emit_seq FROM {ISSUES} WHERE severity = 'high' AND category = 'style'")
def issues_selected(spark, d):
    return results.selected(events_as_issues(spark, d), "high", "style").select("file_path", "severity", "category", "emit_seq")


def _ids(column, values):
    return f"SELECT s.{column}, count(i.emit_seq) AS n, coalesce(sum(i.emit_seq * (i.place % 7 + 1)), 0) AS ordered FROM (VALUES {', '.join(f'({v!r})' for v in values)}) s({column}) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY emit_seq) AS place FROM {ISSUES}) i USING ({column}) GROUP BY 1"


def _digest(rows, column):
    """How many ids, and a sum that depends on their order."""
    order = F.aggregate(F.transform("ids", lambda x, i: x * ((i + 1) % 7 + 1)), F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select(column, F.size("ids").cast("long").alias("n"), order.alias("ordered"))


@query(_ids("severity", SEVERITIES))
def issues_of_severities(spark, d):
    return _digest(results.grouped(events_as_issues(spark, d), "severity"), "severity")


@query(_ids("category", CATEGORIES))
def issues_of_categories(spark, d):
    return _digest(results.grouped(events_as_issues(spark, d), "category"), "category")


@query(f"SELECT emit_seq, severity, substr(title, 1, 5) AS title FROM {ISSUES} WHERE severity IN ('critical', 'high')")
def issues_severest(spark, d):
    return results.severest(events_as_issues(spark, d), 5).select("emit_seq", "severity", "title")


@query(f"SELECT CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 1 ELSE 0 END AS code FROM {ISSUES}")
def report_exit_code(spark, d):
    return results.exit_code(events_as_issues(spark, d))


@query(f"""SELECT analyzer, place, severity, title, file_path, line_number, n - least(n, 5) AS more FROM (SELECT category AS analyzer, severity, substr(title, 1, 50) AS title, file_path, line_number, emit_seq,
 CAST(row_number() OVER (PARTITION BY category ORDER BY {RANK}, emit_seq) AS INTEGER) AS place, count(*) OVER (PARTITION BY category) AS n FROM {ISSUES}) WHERE place <= 5""")
def report_first_issues(spark, d):
    return render.first_issues(events_as_issues(spark, d))


#: A result per user: its analyzer, order, status and issues
RESULTS = """(SELECT user_id AS seq, CASE user_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style' ELSE 'complexity' END AS analyzer, CASE user_id % 11 WHEN 3 THEN 'failed' WHEN 5 THEN 'skipped' ELSE 'success' END AS status,
 list(event_id ORDER BY event_id) AS issues, CAST(count(*) AS DOUBLE) AS seconds, max(value) AS top FROM events GROUP BY user_id)"""


def _results(spark, d):
    u = F.col("user_id")
    analyzer = F.when(u % 3 == 0, "security").when(u % 3 == 1, "style").otherwise("complexity")
    status = F.when(u % 11 == 3, "failed").when(u % 11 == 5, "skipped").otherwise("success")
    own = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id"))).alias("issues"), F.count("*").cast("double").alias("seconds"), F.max("value").alias("top"))
    return own.select(u.alias("seq"), analyzer.alias("analyzer"), status.alias("status"), "issues", "seconds", "top")


@query(f"SELECT analyzer, seq, CAST(unnest(range(len(issues))) AS INTEGER) AS place, unnest(issues) AS event_id FROM {RESULTS}")
def issues_flattened(spark, d):
    return results.flattened(_results(spark, d))


@query(f"SELECT status, count(*) AS n, sum(seq) AS seqs FROM {RESULTS} WHERE status <> 'skipped' GROUP BY 1")
def results_by_status(spark, d):
    own = _results(spark, d)
    return results.with_status(own).unionByName(results.with_status(own, failed=True)).groupBy("status").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("SELECT DISTINCT o_orderpriority AS analyzer FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def analyzers_enabled(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("analyzer")).distinct()
    return results.enabled(names, spark.createDataFrame([("1-URGENT", False), ("2-HIGH", True), ("5-LOW", False)], "analyzer string, enabled boolean"))


@query(f"SELECT analyzer, count(*) AS n, round(max(value_num), 2) AS most FROM {METRICS} GROUP BY 1")
def metrics_grouped(spark, d):
    own = results.metrics_by_analyzer(_metrics(spark, d).withColumnRenamed("value_num", "value"))
    values = F.map_values("metrics")
    return own.select("analyzer", F.size("metrics").cast("long").alias("n"), F.round(F.array_max(values), 2).alias("most"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_size % 7 = 0 THEN 7.5 ELSE CAST(p_size % 4 AS DOUBLE) END AS threshold FROM part")
def setting_or_default(spark, d):
    value = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 4).cast("double"))
    return table(spark, d, "part").select("p_partkey", results.setting(value, 7.5).alias("threshold"))


@query(f"""WITH r AS (SELECT * FROM {RESULTS} WHERE analyzer = 'style'), i AS (SELECT seq, unnest(issues) AS e FROM r)
 SELECT 'style' AS analyzer, coalesce(arg_min(status, seq) FILTER (status <> 'success'), 'success') AS status, sum(seconds) AS seconds, (SELECT count(*) FROM i) AS n_issues,
 (SELECT CAST(first(e ORDER BY seq, e) AS VARCHAR) FROM i) AS first_issue, arg_max(top, seq) AS top FROM r""")
def results_merged(spark, d):
    own = _results(spark, d).filter("analyzer = 'style'").withColumn("issues", F.transform("issues", lambda x: x["event_id"].cast("string")))
    rows = own.select("analyzer", "seq", "status", "seconds", "issues", F.array().cast("array<string>").alias("insights"), F.create_map(F.lit("top"), "top").alias("metrics"))
    return results.merged(rows).select("analyzer", "status", "seconds", F.size("issues").cast("long").alias("n_issues"), F.get("issues", F.lit(0)).alias("first_issue"), F.col("metrics")["top"].alias("top"))


GRADE = "CASE " + " ".join(f"WHEN score >= {x} THEN '{g}'" for g, x in GRADES) + " ELSE 'F' END"


@query(f"SELECT round(score, 6) AS score, {GRADE} AS grade FROM (SELECT greatest(0.0, least(100.0, sum(score_observed * CAST({WEIGHT} AS DOUBLE)) / sum(CAST({WEIGHT} AS DOUBLE)) * 100)) AS score FROM {SCORES} WHERE analyzer <> 'style')")
def overall_of_successes(spark, d):
    status = spark.createDataFrame([("security", "success"), ("style", "failed"), ("complexity", "success"), ("architecture", "success")], "analyzer string, status string")
    return results.successful_overall(scoring.analyzer_scores(events_as_issues(spark, d), _metrics(spark, d)), status).select(F.round("score", 6).alias("score"), "grade")


A = pieces.ARCHITECTURE
#: By piece of ARCHITECTURE: all functions, methods
SIZES = ((0, 0), (3, 3), (3, 3), (11, 11), (4, 4), (1, 0), (2, 2), (9, 9), (0, 0), (2, 2), (1, 1))


def _of_pieces(k):
    return " + ".join(f"CASE WHEN {p.here} THEN {s[k]} ELSE 0 END" for p, s in zip(A, SIZES))


@query(f"""SELECT (SELECT count(*) FROM part) AS total_files, (SELECT CAST(sum({line_total(A)} - 1) AS BIGINT) FROM part) AS total_lines, (SELECT count(*) FROM part) AS total_python_files, CAST(0 AS BIGINT) AS total_test_files,
 CAST(sum({_of_pieces(0)}) AS BIGINT) AS total_functions, CAST((SELECT sum(classes) FROM {MODULES}) AS BIGINT) AS total_classes, CAST(sum({_of_pieces(1)}) AS BIGINT) AS total_methods,
 (SELECT count(*) FROM ({found_sql(A)})) AS total_issues, (SELECT count(*) FROM ({found_sql(A)}) WHERE severity = 'high') AS high_issues, (SELECT count(*) FROM ({found_sql(A)}) WHERE severity = 'medium') AS medium_issues,
 CAST(2 AS BIGINT) AS analyzers_run, CAST(1 AS BIGINT) AS analyzers_failed, 3.5 AS execution_time_seconds, 81.5 AS code_coverage FROM part""")
def report_summary(spark, d):
    ran = spark.createDataFrame([("architecture", "success", 1.5, None, None), ("test_quality", "failed", 2.0, 81.5, 20.0), ("style", "skipped", 0.0, None, None)], "analyzer string, status string, seconds double, coverage double, test_ratio double")
    own = results.summary(detectors.facts(spark, d, A, "architecture"), mosaic_files(spark, d, A), ran)
    return own.select("total_files", "total_lines", "total_python_files", "total_test_files", "total_functions", "total_classes", "total_methods", "total_issues", "high_issues", "medium_issues", "analyzers_run", "analyzers_failed", "execution_time_seconds", "code_coverage")


@query(f"SELECT round(avg(cyclomatic), 2) AS avg_cyclomatic_complexity, CAST(max(cyclomatic) AS BIGINT) AS max_cyclomatic_complexity, round(sum(cognitive) / count(*), 2) AS avg_cognitive_complexity FROM {BLOCKS}")
def report_complexity(spark, d):
    ran = spark.createDataFrame([], "analyzer string, status string, seconds double, coverage double, test_ratio double")
    own = results.summary(detectors.facts(spark, d, pieces.COMPLEXITY, "complexity"), mosaic_files(spark, d, pieces.COMPLEXITY), ran)
    return own.select("avg_cyclomatic_complexity", "max_cyclomatic_complexity", "avg_cognitive_complexity")


@query("SELECT event_type AS category, count(*) AS n, count(DISTINCT user_id) AS files FROM events GROUP BY 1")
def fixes_by_category(spark, d):
    return results.fixes_by_category(table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").alias("file_id")))


# --- validation and caches ------------------------------------------------------------------------------------------

URLS = ("https://github.com/a/b", "https://github.com/a", "http://x.org/a/b", "a/b")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'no owner and name' WHEN 2 THEN 'not a GitHub url' WHEN 3 THEN 'invalid url' END AS url, p_size % 4 < 2 AS github, CASE WHEN length(p_brand) < 10 THEN 'too short' END AS key, CASE WHEN p_size % 3 = 0 THEN 'starts with /' WHEN p_size % 3 = 1 THEN 'empty' END AS pattern FROM part")
def settings_checked(spark, d):
    size = F.col("p_size")
    url = F.element_at(F.array(*map(F.lit, URLS)), (size % 4 + 1).cast("int"))
    pattern = F.element_at(F.array(F.lit("/x"), F.lit(""), F.lit("**/*.py")), (size % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", results.github_url_error(url).alias("url"), results.is_github_url(url).alias("github"), results.api_key_error(F.col("p_brand")).alias("key"), results.pattern_error(pattern).alias("pattern"))


NOW = "(SELECT max(ts) FROM events)"


def _entries(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("written"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000).alias("used"))


def _now(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


@query(f"SELECT event_id AS key FROM events WHERE epoch_us({NOW}) - epoch_us(ts) <= 24 * 3600000000")
def cache_fresh(spark, d):
    return results.fresh(_entries(spark, d), _now(spark, d)).select("key")


@query(f"SELECT event_id AS key FROM events WHERE epoch_us({NOW}) - epoch_us(ts) <= 48 * 3600000000 ORDER BY epoch_us(ts) + event_id % 1000 DESC, event_id LIMIT 100")
def cache_least_recent_out(spark, d):
    return results.least_recent_out(_entries(spark, d), _now(spark, d), 48, 100).select("key")


@query("SELECT event_id, sha256('[\"' || event_type || '\",\"' || CAST(user_id AS VARCHAR) || '\"]') AS key FROM events")
def cache_keys(spark, d):
    return table(spark, d, "events").select("event_id", results.cache_key(F.col("event_type"), F.col("user_id")).alias("key"))


@query("SELECT count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens, round(100.0 * avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS hit_rate FROM events")
def ai_usage(spark, d):
    log = table(spark, d, "events").select((F.col("event_id") % 100).alias("tokens"), (F.col("event_type") == "click").alias("hit"))
    return results.usage(log).withColumn("hit_rate", F.round("hit_rate", 6))


# --- answers --------------------------------------------------------------------------------------------------------


def _answers(spark, d):
    """Answers with a score, a list of texts and objects, a single text, and a list of findings; every fifth is no JSON."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    json = F.concat(F.lit('{"score": '), (F.col("event_id") % 120).cast("string"), F.lit(', "suggestions": ["'), kind, F.lit('", {"text": "t'), n, F.lit('"}, {"x": 1}], "next_steps": "go", "violations": [{"k": '), n, F.lit('}, "v"]}'))
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("no JSON")).otherwise(json).alias("answer"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ',t' || event_id || ',go' END AS recommendations, CASE WHEN event_id % 5 = 0 THEN '' ELSE '{"k":' || event_id || '},{"description":"v"}' END AS issues,
 event_id % 5 <> 0 AS valid, CASE WHEN event_id % 5 = 0 THEN '0 recommendations; 0 issues' ELSE 'score ' || (event_id % 120) || '.0; 3 recommendations; 2 issues' END AS summary FROM events""")
def answers_read(spark, d):
    a = F.col("answer")
    return _answers(spark, d).select(
        "event_id", F.array_join(responses.recommendations(a), ",").alias("recommendations"), F.array_join(responses.issues(a), ",").alias("issues"), responses.valid(a, ("score", "suggestions"), True).alias("valid"), responses.summary(a).alias("summary")
    )


# --- rewriting ------------------------------------------------------------------------------------------------------

FIXED = "list_transform(l, lambda x, i: CASE WHEN i % 3 = 1 AND starts_with(x, 'a') THEN 'fixed' ELSE x END)"
DOCUMENT_LINES = "(SELECT CAST(doc_id AS VARCHAR) AS file_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


@query(f"SELECT file_id, sha256(array_to_string({FIXED}, chr(10))) AS sha256, CAST(len(list_filter(l, lambda x, i: i % 3 = 1 AND starts_with(x, 'a'))) AS BIGINT) AS n_applied FROM {DOCUMENT_LINES}")
def rewrite_replacements(spark, d):
    """Fixes for every third line; those whose original begins with `a` still fit."""
    files = documents_as_files(spark, d)
    line = files.select("file_id", F.posexplode(F.split("code", "\n", -1)).alias("k", "line")).filter("k % 3 = 0")
    fixes = line.select("file_id", (F.col("k") + 1).alias("line_number"), F.when(F.col("line").startswith("a"), F.col("line")).otherwise(F.concat(F.lit("stale "), "line")).alias("original"), F.lit("fixed").alias("replacement"))
    return rewrite.apply_replacements(files, fixes).select("file_id", F.sha2("code", 256).alias("sha256"), "n_applied")


N = detectors.N
#: By piece of NAMES: what is public and has no docstring
BARE = {1: (("tmp", "function", 1),), 5: (("deep", "function", 1),), 6: (("busy", "function", 1), ("inner", "function", 8))}


@query(" UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST({line} AS INTEGER) AS line_number, '{kind}' AS kind, '{name}' AS name FROM part WHERE {N[k].here}" for k, found in BARE.items() for name, kind, line in found))
def docstrings_missing(spark, d):
    return rewrite.missing_docstrings(mosaic_files(spark, d, N))


@query("SELECT CAST(p_partkey AS VARCHAR) AS file_id, CAST(CASE " + " ".join(f"WHEN {N[k].here} THEN {len(found)}" for k, found in BARE.items()) + " ELSE 0 END AS BIGINT) AS n_inserted, CAST(0 AS BIGINT) AS still_missing FROM part")
def docstrings_inserted(spark, d):
    done = rewrite.insert_docstrings(mosaic_files(spark, d, N))
    left = rewrite.missing_docstrings(done).groupBy("file_id").agg(F.count("*").alias("n"))
    return done.select("file_id", "n_inserted").join(left, "file_id", "left").select("file_id", "n_inserted", F.coalesce("n", F.lit(0)).alias("still_missing"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[OK] ' ELSE '[WARN] ' END || 'f = open(p, "w", encoding="utf-8"); g = open(q, ''r'', encoding=''utf-8'', errors=''replace''); h = open(p, "rb")' AS code FROM part""")
def rewrite_encoding(spark, d):
    sign = F.when(F.col("p_size") % 2 == 0, "✅ ").otherwise("⚠️ é")
    code = F.concat(sign, F.lit("""f = open(p, "w"); g = open(q, 'r'); h = open(p, "rb")"""))
    clean = rewrite.with_encoding(rewrite.plain_signs(code))
    return table(spark, d, "part").select("p_partkey", clean.alias("code"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS n_lines FROM documents")
def line_counts(spark, d):
    from ..operators.text_metrics import line_count

    return documents_as_files(spark, d).select("file_id", line_count(F.col("code")).alias("n_lines"))


@query(f"SELECT round(avg(identifier_entropy), 6) AS entropy, count(*) AS files FROM (SELECT log2(distinct_names) AS identifier_entropy FROM {NAMED})")
def entropy_of_code(spark, d):
    own = detectors.engine.file_measures(detectors.facts(spark, d, N, "cognitive_load"), "identifier_entropy")
    return own.agg(F.round(F.avg("identifier_entropy"), 6).alias("entropy"), F.count("*").alias("files"))

