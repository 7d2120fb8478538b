"""Queries on tool reports, test quality, rewriting, taint and the limiter, each beside its SQL where there is one. Reports and
code are made from table rows; the SQL has the closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, reports, rewrite
from ..sources import pyast
from ..sources.tables import documents_as_files, spread, table
from ..streaming import token_bucket
from .queries import query

USER = "CAST(user_id AS VARCHAR)"


def _report(events, fields, wrap=lambda found: found):
    """One report per user: the JSON of the user's findings."""
    found = F.collect_list(F.struct(*fields))
    return events.groupBy("user_id").agg(wrap(found).alias("f")).select(F.to_json("f").alias("report"))


def _path():
    return F.col("user_id").cast("string")


@query(f"""SELECT {USER} AS file_path, CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'low' ELSE 'medium' END AS severity,
 'B' || CAST(event_id % 700 AS VARCHAR) AS rule_id, event_type AS title, CAST(event_id AS BIGINT) AS line_number FROM events""")
def report_bandit(spark, d):
    level = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "signup", "LOW").when(F.col("event_type") == "click", "MEDIUM").otherwise("UNDEFINED")
    fields = (_path().alias("filename"), level.alias("issue_severity"), F.col("event_type").alias("issue_text"), F.col("event_id").alias("line_number"), F.concat(F.lit("B"), (F.col("event_id") % 700).cast("string")).alias("test_id"))
    return reports.bandit(_report(table(spark, d, "events"), fields, lambda found: F.struct(found.alias("results"))))


@query(f"""SELECT {USER} AS file_path, CASE event_id % 6 WHEN 1 THEN 'info' WHEN 2 THEN 'medium' WHEN 3 THEN 'info' ELSE 'low' END AS severity,
 substr('EWFCNX', CAST(event_id % 6 + 1 AS INTEGER), 1) || '1' AS rule_id, event_type AS title, CAST(event_id AS BIGINT) AS line_number FROM events""")
def report_ruff(spark, d):
    code = F.concat(F.element_at(F.array(*map(F.lit, "EWFCNX")), (F.col("event_id") % 6 + 1).cast("int")), F.lit("1"))
    fields = (code.alias("code"), _path().alias("filename"), F.col("event_type").alias("message"), F.struct(F.col("event_id").alias("row")).alias("location"))
    return reports.ruff(_report(table(spark, d, "events"), fields))


@query(f"SELECT {USER} AS file_path, 'low' AS severity, 'E' || CAST(event_id % 9 AS VARCHAR) AS rule_id, event_type AS title, CAST(event_id AS BIGINT) AS line_number FROM events")
def report_flake8(spark, d):
    fields = (F.concat(F.lit("E"), (F.col("event_id") % 9).cast("string")).alias("code"), F.col("event_type").alias("text"), F.col("event_id").alias("line_number"))
    return reports.flake8(_report(table(spark, d, "events"), fields, lambda found: F.create_map(F.first(_path()), found)))


BRANCH = "CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE 100.0 * (p_size % 3) / (p_size % 5) END"


@query(f"""SELECT p_partkey, CAST(p_size AS DOUBLE) AS statement, round({BRANCH}, 6) AS branch, round(0.6 * p_size + 0.4 * {BRANCH}, 6) AS effectiveness,
 {BRANCH} < 70 AND p_size % 5 > 0 AS low_branch FROM part""")
def report_coverage(spark, d):
    size = F.col("p_size")
    totals = F.struct(size.cast("double").alias("percent_covered"), (size % 5).alias("num_branches"), (size % 3).alias("covered_branches"))
    out = reports.coverage(table(spark, d, "part").select("p_partkey", F.to_json(F.struct(totals.alias("totals"))).alias("report")))
    return out.withColumns({c: F.round(c, 6) for c in ("branch", "effectiveness")})


@query(f"""SELECT event_id, {USER} || CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN ':' || CAST(event_id % 4 AS VARCHAR)
 ELSE ':' || CAST(event_id % 4 AS VARCHAR) || ':' || CAST(event_id % 3 AS VARCHAR) END AS location FROM events""")
def issue_location(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", reports.location(_path(), e % 4, e % 3).alias("location"))


@query("""SELECT event_type AS analyzer, CAST(sum(event_id % 7) AS BIGINT) AS seconds, CAST(sum(event_id % 5) AS BIGINT) AS n_issues,
 coalesce(arg_min(CASE event_id % 11 WHEN 3 THEN 'failed' ELSE 'skipped' END, event_id) FILTER (event_id % 11 IN (3, 5)), 'success') AS status FROM events GROUP BY 1""")
def merge_results(spark, d):
    e = F.col("event_id")
    status = F.when(e % 11 == 3, "failed").when(e % 11 == 5, "skipped").otherwise("success")
    rows = table(spark, d, "events").select(F.col("event_type").alias("analyzer"), e.alias("seq"), (e % 7).cast("long").alias("seconds"), (e % 5).cast("long").alias("n_issues"), status.alias("status"))
    return reports.merge(rows)


@query(f"SELECT event_type AS analyzer, {USER} AS name, CAST(arg_max(event_id % 97, event_id) AS BIGINT) AS value_num FROM events GROUP BY ALL")
def merge_metrics(spark, d):
    e = F.col("event_id")
    return reports.merge_metrics(table(spark, d, "events").select(F.col("event_type").alias("analyzer"), _path().alias("name"), e.alias("seq"), (e % 97).cast("long").alias("value_num")))


PATHS = ("tests/test_a.py", "src/core.py", "src/core_test.py", "setup.py", "src/contest.py", "docs/readme.md")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file_id, p_size % 6 IN (0, 2, 4) AS test_in_summary, p_size % 6 IN (0, 2) AS is_test, p_size % 6 IN (1, 4) AS is_source FROM part")
def file_roles(spark, d):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_size") % 6 + 1).cast("int"))
    return quality.file_roles(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_id"), path.alias("path")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes FROM documents ORDER BY size_bytes DESC, file_id LIMIT 5""")
def files_largest(spark, d):
    return documents_as_files(spark, d).select("file_id", F.octet_length("code").cast("long").alias("size_bytes")).orderBy(F.desc("size_bytes"), "file_id").limit(5)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def benchmark_stats(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.percentile(x, F.lit(0.5)), 4).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("""SELECT p_partkey, CASE WHEN s = 0 THEN 0.0 ELSE 100.0 * t / s END AS ratio,
 CASE WHEN t > 0 THEN 20 ELSE 0 END + CASE WHEN s = 0 THEN 0 WHEN 100 * t >= 75 * s THEN 25 WHEN 100 * t >= 50 * s THEN 20 WHEN 100 * t >= 30 * s THEN 15 WHEN 100 * t >= 10 * s THEN 10 ELSE 0 END
 + CASE WHEN n >= 50 THEN 20 WHEN n >= 20 THEN 15 WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 ELSE 0 END + CASE WHEN n = 0 THEN 0 WHEN a >= 3 * n THEN 20 WHEN a >= 2 * n THEN 15 WHEN a >= n THEN 10 ELSE 0 END
 + CASE WHEN t >= 10 THEN 15 WHEN t >= 5 THEN 10 WHEN t >= 2 THEN 5 ELSE 0 END AS readiness FROM (SELECT p_partkey, p_size % 12 AS t, p_partkey % 17 AS s, p_size AS n, p_partkey % 160 AS a FROM part)""")
def mutation_readiness(spark, d):
    p = table(spark, d, "part")
    counts = p.select("p_partkey", (F.col("p_size") % 12).alias("n_test_files"), (F.col("p_partkey") % 17).alias("n_source_files"), F.col("p_size").alias("n_tests"), (F.col("p_partkey") % 160).alias("n_assertions"))
    return quality.mutation_readiness(counts).select("p_partkey", "ratio", "readiness")


@query("""SELECT p_partkey, CASE WHEN l = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, (171 - 5.2 * ln(3 * l) - 0.23 * c - 16.2 * ln(l)) / 171 * 100)), 6) END AS score
 FROM (SELECT p_partkey, (p_partkey % 400) * 50 AS l, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 1.0 END AS c FROM part)""")
def maintainability_index(spark, d):
    cc = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double"))
    return table(spark, d, "part").select("p_partkey", F.round(quality.maintainability((F.col("p_partkey") % 400) * 50, cc), 6).alias("score"))


@query("""SELECT p_partkey, round(v, 6) AS volume, round(f, 6) AS difficulty, round(v * f, 4) AS effort, round(v * f / 18, 4) AS time, round(v / 3000, 9) AS bugs FROM (SELECT p_partkey,
 CASE WHEN a + b > 0 THEN (x + y) * log2(a + b) ELSE 0.0 END AS v, CASE WHEN b > 0 THEN a / 2.0 * y / b ELSE 0.0 END AS f FROM (SELECT p_partkey, p_size % 9 AS a, p_size % 6 AS b, p_size AS x, p_size + 3 AS y FROM part))""")
def halstead_measures(spark, d):
    s = F.col("p_size")
    digits = {"volume": 6, "difficulty": 6, "effort": 4, "time": 4, "bugs": 9}
    return table(spark, d, "part").select("p_partkey", *(F.round(c, digits[k]).alias(k) for k, c in quality.halstead(s % 9, s % 6, s, s + 3).items()))


def _lines_of(n, line):
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(60)), lambda i: i < n), line), "")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file_id, 'test_it' AS func, CAST(p_size % 8 AS BIGINT) AS n_asserts, CAST(p_size % 8 + p_partkey % 60 + 2 AS BIGINT) AS n_lines,
 p_size % 8 = 0 AS bare, p_size % 8 > 5 AS lazy, p_size % 8 + p_partkey % 60 + 2 > 50 AS long FROM part""")
def test_smells(spark, d):
    asserts = _lines_of(F.col("p_size") % 8, lambda i: F.when(i % 2 == 0, F.lit(" assert x\n")).otherwise(F.lit(" self.assertEqual(x, 1)\n")))
    code = F.concat(F.lit("def test_it(self):\n"), asserts, _lines_of(F.col("p_partkey") % 60, lambda i: F.lit(" work()\n")), F.lit(" done()\ndef other():\n assert 1\n"))
    return quality.tests(pyast.nodes(spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").cast("string").alias("file_id"), code.alias("code"))))


@query("SELECT CAST(p_partkey AS VARCHAR) AS file_id, 'x' AS name, 'system' AS sink, CAST(4 AS BIGINT) AS line_number FROM part WHERE p_size % 3 = 0")
def taint_flows(spark, d):
    source = F.when(F.col("p_size") % 3 == 0, "input()").otherwise("clean()")
    code = F.concat(F.lit("import os\nx = "), source, F.lit("\ny = 1\nos.system(x)\nos.system(y)\nprint(x)\n"))
    files = spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").cast("string").alias("file_id"), code.alias("code"))
    return quality.taint_flows(pyast.nodes(files), ("input", "raw_input"), ("system", "execute"))


DIRTY = """(SELECT CAST(doc_id AS VARCHAR) AS file_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN length(x) % 2 = 0 THEN x || ' ' || chr(9) WHEN length(x) % 3 = 0 THEN '  except : ' ELSE x END) AS l FROM documents)"""
CLEAN = "list_transform(l, lambda x: CASE WHEN x = '  except : ' THEN '  except Exception:' ELSE rtrim(x, ' ' || chr(9)) END)"


@query(f"SELECT file_id, sha256(array_to_string({CLEAN}, chr(10))) AS sha256, CAST(list_sum(list_transform(list_zip(l, {CLEAN}), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS n_changed FROM {DIRTY}")
def rewrite_lines(spark, d):
    dirty = F.transform(F.split("code", "\n", -1), lambda x: F.when(F.length(x) % 2 == 0, F.concat(x, F.lit(" \t"))).when(F.length(x) % 3 == 0, F.lit("  except : ")).otherwise(x))
    files = documents_as_files(spark, d).select("file_id", F.array_join(dirty, "\n").alias("code"))
    return rewrite.fix_lines(files).select("file_id", F.sha2("code", 256).alias("sha256"), "n_changed")


@query("SELECT file_id, sha256(clean) AS sha256, CAST(length(code) - length(clean) AS BIGINT) AS n_removed FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, coalesce(text, '') AS code, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g') AS clean FROM documents)")
def rewrite_ascii(spark, d):
    return rewrite.ascii_only(documents_as_files(spark, d)).select("file_id", F.sha2("code", 256).alias("sha256"), "n_removed")


#: A client's requests one after the other: tokens flow in, a request takes one if there is one
BUCKETS = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id AS request, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 b AS (SELECT client, request, t, n, 3.0::DOUBLE - 1 AS tokens, true AS admitted FROM e WHERE n = 1
  UNION ALL SELECT client, request, t, n, tokens - CASE WHEN tokens >= 1 THEN 1 ELSE 0 END, tokens >= 1 FROM (SELECT e.client, e.request, e.t, e.n, least(3.0::DOUBLE, b.tokens + greatest(0.0, e.t - b.t) * (2.0::DOUBLE / 86400)) AS tokens FROM b JOIN e ON e.client = b.client AND e.n = b.n + 1))
 SELECT client, request, admitted FROM b"""


@query(BUCKETS)
def token_bucket_stream(spark, d):
    """The limiter on all events, 2 requests a day and bursts of 3 per user; tests/test_engine.py holds it against a plain loop."""
    return token_bucket.run_on_files(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, 2 / 86400, 3.0)


@query(BUCKETS)
def token_bucket_timers(spark, d):
    """The same by timers, which let the state of idle users go."""
    return token_bucket.run_with_timers(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, 2 / 86400, 3.0)[0]
