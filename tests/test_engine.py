import pytest

import __spark_entry__
from codeloom.functions import jsonx
from codeloom.operators import findings, reports, rewrite, rules, scoring, structure, text_metrics
from codeloom.plans.catalog import QUERIES
from codeloom.schema import grade
from codeloom.sources import pyast
from codeloom.sources.tables import lines, read_source_tree


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert 0 <= row["score"] <= 100 and row["grade"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_source_tree_holds_underscore_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/__init__.py").write_text("")
    (tmp_path / "src/a.py").write_bytes(b"x = 1\r\ny = 2\r")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "big.py").write_text("#" * 3000)
    got = {r["name"]: r["code"] for r in read_source_tree(spark, str(tmp_path), largest_kb=2).collect()}
    assert got == {"__init__.py": "", "a.py": "x = 1\ny = 2\n"}


def files(spark, *codes):
    return spark.createDataFrame([(str(k), c) for k, c in enumerate(codes)], "file_id string, code string")


def test_complexity_of_known_code(spark):
    nested = "def f(a, b, c, d):\n if a:\n  if b:\n   if c:\n    if d:\n     return 1\n    else:\n     return 2\n   else:\n    return 3\n  else:\n   return 4\n else:\n  return 5\n"
    f = files(spark, nested, "def oops(:", "", "def g(x):\n for i in x:\n  if i and x or 1:\n   pass\n")
    got = {(r["file_id"], r["func"]): r for r in structure.functions(f).collect()}
    r = got["0", "f"]
    assert (r["nesting"], r["cognitive"], r["cyclomatic"], r["missing_else"], r["n_args"]) == (4, 10, 5, 0, 4)
    r = got["3", "g"]
    assert (r["nesting"], r["cyclomatic"], r["cognitive"]) == (2, 5, 5)
    assert got["0", "f"]["npath"] == 9
    assert [r["file_id"] for r in pyast.nodes(f).filter("parse_error is not null").collect()] == ["1"]


def test_secrets(spark):
    code = 'a = 1\nDATABASE_PASSWORD = "super_secret_123"\n# api_key = "abcdefghijkl"\ntoken = "test_abcdefgh"\n'
    got = text_metrics.secrets(files(spark, code)).collect()
    assert [(r["kind"], r["line_no"]) for r in got] == [("password", 2)]


@pytest.mark.parametrize("score, want", [(95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (60, "D"), (59.9, "F"), (0, "F"), (-3, "F")])
def test_grades(spark, score, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(grade(F.lit(float(score)))).first()[0] == want


def issues(spark, rows):
    return spark.createDataFrame([(a, s, "security", t, f, n, "r", k) for k, (a, s, t, f, n) in enumerate(rows)], "analyzer string, severity string, category string, title string, file_path string, line_number int, rule_id string, emit_seq long")


def test_findings(spark):
    df = issues(spark, [("x", "low", "t", None, 1), ("x", "low", "t", None, 1), ("x", "critical", "t", "a", 1), ("x", "low", "t", "a", 1)])
    once = findings.dedup(df)
    assert sorted(r["emit_seq"] for r in once.collect()) == [0, 2, 3] == sorted(r["emit_seq"] for r in findings.dedup(once).collect())
    assert [r["emit_seq"] for r in findings.top_n(df, 2).collect()] == [2, 0]
    assert {r["severity"]: r["n"] for r in findings.by_severity(df.limit(0)).collect()} == dict.fromkeys(("critical", "high", "medium", "low", "info"), 0)


def test_scores(spark):
    metric = "analyzer string, name string, value_num double, threshold double, passed boolean"
    none = spark.createDataFrame([], metric)
    one = lambda rows, m: findings and scoring.analyzer_scores(issues(spark, rows), m).first()
    assert abs(one([("x", "high", "t", "f", k) for k in range(2)], spark.createDataFrame([("x", "m", 1.0, 2.0, True)], metric))["score_7030"] - 0.94) < 1e-9
    assert abs(one([("x", "critical", "t", "f", 1)], none)["score_7030"] - 0.94) < 1e-9
    assert abs(one([("x", "critical", "t", "f", k) for k in range(10)], none)["score_7030"] - 0.7) < 1e-9


def test_json(spark):
    from pyspark.sql import functions as F

    texts = ['{"score": 7}', '```json\n{"score": 8}\n```', "```\n{\"score\": 9}\n```", 'so {"score": 10} it is', "{'score': 11,}", "{score: 12}", "nothing", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.select(jsonx.score(jsonx.extract(F.col("t")), ("rating", "score")), "k").orderBy("k").collect()]
    assert got == [7, 8, 9, 10, 11, 12, None, None]


def test_rules(spark):
    own = [{"id": "a", "pattern": "x+", "excludes": ["no"], "requires": ["alpha"]}, {"id": "b", "pattern": "never"}]
    f = files(spark, "alpha xx\nno x\nx", "beta x")
    hits = rules.regex_hits(lines(f), own)
    assert sorted((r["file_id"], r["line_no"], r["hit"]) for r in hits.collect()) == [("0", 1, "xx"), ("0", 3, "x"), ("1", 1, "x")]
    assert {r["rule_id"]: r["violations"] for r in rules.counts(hits, rules.rule_table(spark, own)).collect()} == {"a": 3, "b": 0}
    assert sorted(map(tuple, rules.required(f, own).collect())) == [("a", "0"), ("b", "0"), ("b", "1")]


def test_token_bucket(spark, data):
    got = {(r.client, r.request): r.admitted for r in QUERIES["token_bucket_stream"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr("cast(user_id as string) u", "event_id", "cast(cast(ts as timestamp) as double) t").collect()
    bucket, want = {}, {}
    for u, e, t in sorted(map(tuple, rows), key=lambda r: (r[2], r[1])):
        tokens, last = bucket.get(u, (3.0, t))
        tokens = min(3.0, tokens + (t - last) * 2 / 86400)
        want[u, e] = tokens >= 1
        bucket[u] = (tokens - want[u, e], t)
    assert got == want and len(set(want.values())) == 2


def test_broken_reports_give_nothing(spark):
    bad = spark.createDataFrame([("no json",), (None,), ("",), ("[]",), ("{}",)], "report string")
    assert not any(f(bad).count() for f in (reports.bandit, reports.ruff, reports.flake8, reports.coverage))


def test_rewrite_of_nothing(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "DEBUG = True \nDEBUGGER=True\n debug=True\nx = 1  # except:")], "file_id string, code string")
    got = {r.file_id: (r.code, r.n_changed) for r in rewrite.fix_lines(files).collect()}
    assert got == {"a": (None, 0), "b": ("", 0), "c": ("DEBUG = False\nDEBUGGER=True\n debug = False\nx = 1  # except:", 2)}
