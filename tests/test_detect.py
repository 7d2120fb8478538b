"""Detectors on code with known answers, and operators against plain loops."""

import ast
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.detect import complexity, edge_cases, engine, readability, rules, security, style, test_code
from codeloom.detect import source as source_module
from codeloom.operators import graph, project, responses, results, structure, text_metrics
from codeloom.sources import pyast


def source(code, path="src/a.py"):
    return engine.parse("a", path, code)


def found(detect, code, path="src/a.py"):
    return [(f.name, f.line_number) for f in detect(source(code, path)) if f.kind == "issue"]


def files(spark, *codes):
    return spark.createDataFrame([(str(k), f"src/m{k}.py", c) for k, c in enumerate(codes)], "file_id string, path string, code string")


WITH = "def f(x):\n with x:\n  try:\n   with x:\n    if x:\n     pass\n  except E:\n   pass\n"


def test_blocks_below_with_and_try_count():
    f = ast.parse(WITH).body[0]
    assert complexity.nesting(f) == 4
    # if: 1 + 1; the try: body 1 + 2, handler 1, no finally 1; and 1 to start with
    assert complexity.npath(f.body) == 6
    assert complexity.npath(ast.parse("with a:\n if b:\n  pass\n").body) == 3
    assert complexity.cognitive(f) == 1 + 1 + 1 + 1


def test_comprehensions_and_own_calls_cost():
    f = ast.parse("def f(x):\n return [a for b in x for a in b] + f(x) + g(x) + list(y for y in x)\n").body[0]
    assert complexity.cognitive(f) == 3


def test_nodes_hold_both_nestings(spark):
    tree = pyast.nodes(files(spark, WITH))
    assert tree.filter("kind = 'Pass'").agg(F.max("block_nest"), F.max("nest")).first()[:] == (4, 1)


SECRET_CODES = [
    '# password = "hunter22"\n\npassword = "hunter22"\n',
    'password = "hunter22"\npassword = "hunter22"\n',
    'secret = "aaaa\nbbbb"\npassword: "zzzzzz"\n  # secret = "cccccccc"',
    'x = 1; password = "test1234"; password = "real1234"',
    'PASSWORD="abcd" password="efgh"\n',
    "",
]


def test_every_secret_has_its_own_line(spark):
    want = sorted((str(k), f.name.removeprefix("SECRET_").lower(), f.line_number) for k, c in enumerate(SECRET_CODES) for f in security.secrets(engine.Source("a", "a", c, None)))
    got = sorted((r.file_id, r.kind, r.line_no) for r in text_metrics.secrets(files(spark, *SECRET_CODES)).collect())
    assert got == want
    assert [x[1:] for x in want if x[0] == "0"] == [("password", 3)] and [x[1:] for x in want if x[0] == "1"] == [("password", 1), ("password", 2)]


def test_secrets_against_a_plain_search(spark):
    rng = random.Random(5)
    words = ['password = "abcd1"', "# ", "\n", " ", 'secret: "longer secret"', "'", '"', 'api_key="' + "k" * 20 + '"', "x=1", "sk_live_" + "a" * 24, "AKIA" + "B" * 16]
    codes = ["".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(150)]
    want = []
    for k, code in enumerate(codes):
        for kind, pattern in security.SECRETS.items():
            for m in re.finditer(pattern, code, re.I):
                line = code[: m.start()].count("\n")
                if not code.split("\n")[line].strip().startswith("#") and not any(w in m[0].lower() for w in security.PLACEHOLDERS):
                    want.append((str(k), kind, line + 1, m[0]))
    got = [(r.file_id, r.kind, r.line_no, r.hit) for r in text_metrics.secrets(files(spark, *codes)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_taint():
    code = "def f(request):\n a = input()\n b = 'x' + a\n os.system(b)\n a = 1\n os.system(a)\n os.system(quote(b))\n c = request.args\n db.execute(f'{c}')\ndef g():\n os.system(b)\n"
    assert found(security.taint, code) == [("TAINT_COMMAND", 4), ("TAINT_SQL", 9)]


@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_distance(a, b):
    def plain(x, y):
        return max(len(x), len(y)) if not x or not y else min(plain(x[1:], y) + 1, plain(x, y[1:]) + 1, plain(x[1:], y[1:]) + (x[0] != y[0]))

    if len(a) + len(b) < 11:
        assert style.distance(a, b, 20) == plain(a, b)
    assert style.distance(a, b, 20) == style.distance(b, a, 20)


def test_similar_names_stop_at_five():
    assert len(style.similar({f"value{k}" for k in range(9)})) == 5 and style.similar({"abc", "abd", "long", "other"}) == []


def test_edge_cases():
    code = "def f(a, b):\n return a / b\n" + "x = y / z\n" * 7
    assert [x for x in found(edge_cases.detect, code) if x[0] == "EDGE_OVF001"] == [("EDGE_OVF001", n) for n in range(3, 8)]
    assert found(edge_cases.detect, "if x > True: pass\nif x > 0.0: pass\n").count(("EDGE_BVA001", 2)) == 2


def test_tests_are_judged_in_test_files_alone(spark):
    code = "def test_a():\n    pass\n"
    rows = spark.createDataFrame([("1", "src/a.py", code), ("2", "tests/a.py", code)], "file_id string, path string, code string")
    assert [r.file_id for r in engine.issues(engine.facts(rows, "test_quality")).collect()] == ["2"]
    assert test_code.likeness("abc", "abd") == pytest.approx(2 / 3)


def test_readability():
    assert [readability.kind_of(n) for n in ("x", "Temp", "item12", "get_it", "a_list", "nameStr", "xStr", "Name", "good_name")] == ["meaningless"] * 3 + ["misleading"] * 2 + ["plain", "misleading", "plain", "good"]
    assert readability.logical_lines(source('"""Doc."""\n# no\nif a: b; c\nfor x in y:\n    z = {1: 2,\n        3: 4}\n')) == 5


def test_structure_rules():
    test = rules.structural("$X.append($X)")
    node = lambda code: ast.parse(code).body[0].value
    assert test(node("a.b.append(a.b)")) and test(node("a.append(b)")) is None
    assert rules.structural("f(..., 1, ...)")(node("f(0, 1, 2)")) == {} and rules.structural("f(..., 1)")(node("f(1, 2)")) is None


def test_rule_files(tmp_path):
    (tmp_path / "r.yaml").write_text("rules:\n- id: a\n  pattern: eval(\n  severity: HIGH\n- id: b\n  enabled: false\n- id: c\n  patterns: [x, y]\n  severity: strange\n")
    got = rules.load_rules(str(tmp_path / "r.yaml"))
    assert [(r.id, r.severity, r.patterns_any) for r in got] == [("a", "high", ()), ("c", "medium", ("x", "y"))]
    assert rules.load_rules(str(tmp_path / "none.yaml")) == []


def test_failures_are_facts(spark):
    def broken(_):
        raise KeyError("no")

    rows = files(spark, "def oops(:", None, "", "x = 1\n", "\0")
    got = engine.facts(rows, "style", extra={"broken": broken}).filter("kind in ('parse_error', 'failure')").collect()
    assert sorted((r.file_id, r.kind) for r in got) == [("0", "parse_error"), ("3", "failure"), ("4", "parse_error")]
    assert structure.blocks(rows).count() == 0 and engine.facts(rows.limit(0)).count() == 0


def random_edges(rng, n):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * 1.3))]


def reachable(pairs):
    out = {a: set() for p in pairs for a in p}
    for a, b in pairs:
        out[a].add(b)
    for k in out:
        for a in out:
            if k in out[a]:
                out[a] |= out[k]
    return out


def plain_components(pairs):
    r = reachable([p for p in pairs if p[0] != p[1]])
    groups = {a: min([a, *(b for b in r[a] if a in r[b])]) for a in r}
    several = {g for g in groups.values() if list(groups.values()).count(g) > 1}
    return {(a, g) for a, g in groups.items() if g in several}


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
def test_components_in_one_task(pairs):
    assert set(graph.components_of([p for p in pairs if p[0] != p[1]])) == plain_components(pairs)


def test_components_of_a_distributed_graph(spark):
    rng = random.Random(3)
    pairs = random_edges(rng, 30) + [(100, 101), (101, 100), (100, 102), (102, 103), (103, 102)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = plain_components(pairs)
    assert {tuple(r) for r in graph.cycles(edges, small=0).collect()} == want == {tuple(r) for r in graph.cycles(edges).collect()}
    assert graph.cycles(edges.limit(0)).count() == 0 and graph.cycles(spark.createDataFrame([(1, 2)], "src long, dst long"), small=0).count() == 0


def test_insights(spark):
    rows = engine.facts(files(spark, 'password = "hunter22"\nx = md5(1)\n'), "security")
    said = project.insights(project.wide_metrics(rows, "security"), "security").first()["insights"]
    assert said == [
        "CRITICAL: 1 critical vulnerabilities require immediate attention!",
        "SECRETS: 1 hardcoded credentials detected (23M+ exposed in 2024). Move to secure vault immediately.",
        "Weak cryptographic algorithms detected. Migrate to SHA-256, AES-256, and secrets module.",
        "Total: 2 vulnerabilities across 1 OWASP categories. Implement defense-in-depth strategy.",
    ]
    for analyzer in project.INSIGHTS:
        wide = project.wide_metrics(engine.facts(files(spark, "x = 1\n").limit(0)), analyzer)
        assert project.insights(wide, analyzer).count() == 1


RESULT = "analyzer string, seq int, status string, seconds double, issues array<string>, insights array<string>, metrics map<string,double>"


def test_merging(spark):
    rows = [("a", 2, "failed", 1.5, ["z"], ["i"], {"m": 2.0}), ("a", 1, "success", 1.0, ["x", "y"], [], {"m": 1.0, "k": 3.0}), ("a", 3, "skipped", 0.0, [], [], {})]
    r = results.merged(spark.createDataFrame(rows, RESULT)).first()
    assert (r.status, r.seconds, r.issues, r.insights, r.metrics) == ("failed", 2.5, ["x", "y", "z"], ["i"], {"m": 2.0, "k": 3.0})
    with pytest.raises(Exception, match="different analyzers"):
        results.merged(spark.createDataFrame([*rows, ("b", 4, "success", 0.0, [], [], {})], RESULT)).collect()
    assert results.merged(spark.createDataFrame([], RESULT)).count() == 0


def test_registry_isolates_failures(spark):
    registry = results.Registry()
    registry.add("good", lambda f: engine.facts(f, "style"))
    registry.add("planned", lambda f: f.select("no_such_column"))
    registry.add("run", lambda f: f.select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    registry.add("off", lambda f: f)
    rows, facts = registry.run(files(spark, "x = 1\n"), off=("off",))
    assert {r.analyzer: r.status for r in rows.collect()} == {"good": "success", "planned": "failed", "run": "failed", "off": "skipped"}
    assert set(facts) == {"good"} and facts["good"].count() > 0


def test_validation(spark):
    urls = ["https://github.com/a/b", "https://github.com/a", "http://x.org/a/b", "github.com/a/b", None, "https://GitHub.com/a/b/?q#f"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").orderBy("k")
    assert [r[0] for r in df.select(results.github_url_error(F.col("u"))).collect()] == [None, "no owner and name", "not a GitHub url", "invalid url", "invalid url", None]
    assert [r[0] for r in df.select(results.is_github_url(F.col("u"))).collect()] == [True, True, False, False, False, True]
    one = spark.range(1).select(*(results.api_key_error(F.lit(x)) for x in (None, "", "short", "long enough")), *(results.pattern_error(F.lit(x)) for x in ("", "/a", "**/*.py")))
    assert list(one.first()) == ["required", "required", "too short", None, "empty", "starts with /", None]
    assert results.config_errors({}) == [] and len(results.config_errors({"file_patterns": [], "max_workers": 0, "timeout_seconds": 0, "analyzer_weights": {"a": 0.5}}, ai=True)) == 5


def test_caches(spark):
    rows = [(f"k{k}", k * 3600.0, k * 10.0) for k in range(6)]
    entries = spark.createDataFrame(rows, "key string, w double, u double").select("key", F.timestamp_seconds("w").alias("written"), F.timestamp_seconds("u").alias("used"))
    now = F.timestamp_seconds(F.lit(6 * 3600.0))
    assert sorted(r.key for r in results.fresh(entries, now, 4).collect()) == ["k2", "k3", "k4", "k5"]
    assert [r.key for r in results.least_recent_out(entries, now, 4, 2).collect()] == ["k5", "k4"]


def test_responses(spark):
    text = '{"score": 80, "suggestions": ["a", {"text": "b"}, {"x": 1}, 3], "fixes": "c", "issues": [{"k": 1}, "d", 4], "warnings": "no list"}'
    df = spark.createDataFrame([(text,), ("[1]",), ("no",), (None,)], "t string")
    got = df.select(responses.recommendations(F.col("t")), responses.issues(F.col("t")), responses.valid(F.col("t")), responses.valid(F.col("t"), ("score", "none"), True), responses.summary(F.col("t"))).collect()
    assert got[0][0] == ["a", "b", "c"] and got[0][1] == ['{"k":1}', '{"description":"d"}'] and got[0][2:4] == (True, False) and got[0][4] == "score 80.0; 3 recommendations; 2 issues"
    assert [list(r[:4]) for r in got[1:]] == [[[], [], False, False]] * 3


DEEP = {
    "sum": "x = " + " + ".join(["'a'"] * 5_000),
    "elif": "def g(k):\n    if k == 0:\n        pass\n" + "".join(f"    elif k == {i}:\n        pass\n" for i in range(2_000)),
    "chain": "def g(k):\n    return k" + ".b" * 4_000 + "()\n",
    "signs": "y = " + "-" * 4_000 + "x",
    "call": "cursor.execute(" + " + ".join(["'a'"] * 5_000) + " + name)",
}


@pytest.mark.parametrize("kind", DEEP)
def test_deep_code_keeps_all_findings(kind):
    """Nothing fails on deep trees, and what stands beside them is found."""
    code = 'password = "hunter22!"\ndef f(q):\n    d = input()\n    db.execute(d)\n' + DEEP[kind] + "\n"
    got = list(engine.facts_of("a", "src/a.py", code, list(engine.DETECTORS.items())))
    assert not [f for f in got if f.kind in ("failure", "parse_error")]
    names = {f.name for f in got}
    assert {"SECRET_PASSWORD", "TAINT_SQL", "halstead_volume", "npath"} <= names


def test_code_too_deep_for_the_parser_keeps_what_the_text_shows():
    code = 'password = "hunter22!"\nx = ' + " + ".join(["'a'"] * 40_000)
    got = list(engine.facts_of("a", "src/a.py", code, list(engine.DETECTORS.items())))
    assert [(f.kind, f.name) for f in got] == [("parse_error", "RecursionError"), ("issue", "SECRET_PASSWORD")]


def test_a_failing_part_costs_no_other():
    def half(source):
        yield engine.Fact("x", "measure", "before", value=1.0)
        raise KeyError("k")

    def whole(source):
        yield engine.Fact("x", "measure", "after", value=1.0)

    got = [(f.kind, f.name, f.scope) for f in engine.facts_of("a", None, "x = 1", [("x", source_module.apart("x", half, whole)), ("y", half)])]
    assert got == [("measure", "before", None), ("failure", "KeyError", "half"), ("measure", "after", None), ("measure", "before", None), ("failure", "KeyError", None)]


def plain_npath(body):
    paths, queue = 1, list(reversed(body))
    while queue:
        node = queue.pop()
        match node:
            case ast.If():
                paths += plain_npath(node.body) + plain_npath(node.orelse)
            case ast.For() | ast.While():
                paths += plain_npath(node.body)
            case ast.Try():
                paths += plain_npath(node.body) + sum(plain_npath(h.body) for h in node.handlers) + plain_npath(node.finalbody)
            case ast.BoolOp():
                paths *= len(node.values)
            case _:
                queue.extend(reversed(list(ast.iter_child_nodes(node))))
    return paths


@given(st.recursive(st.sampled_from(["a and b", "pass", "x = a or b or c"]), lambda inner: st.tuples(st.sampled_from(["if a:", "while b and c:", "try:", "for i in x:"]), inner, inner, inner), max_leaves=25))
@settings(deadline=None, max_examples=60)
def test_npath_against_recursion(tree):
    def text(t, pad):
        if isinstance(t, str):
            return f"{pad}{t}\n"
        head, *rest = t
        first, second, third = (text(x, pad + " ") for x in rest)
        tail = f"{pad}except E:\n{second}{pad}finally:\n{third}" if head == "try:" else f"{pad}else:\n{second}{third}" if head == "if a:" else f"{second}{third}"
        return f"{pad}{head}\n{first}{tail}"

    body = ast.parse(text(tree, "")).body
    assert complexity.npath(body) == plain_npath(body)
    exprs = [n for n in ast.walk(ast.Module(body, [])) if isinstance(n, ast.expr)]
    known = {}
    ids = [source_module.identity(n, known) for n in exprs]
    dumps = [ast.dump(n) for n in exprs]
    assert all((a == b) == (x == y) for a, x in zip(ids, dumps) for b, y in zip(ids, dumps))


SHIPPED = {
    "BARE_PRINT": "print(a, b)\n",
    "MUTABLE_DEFAULT": "def f(a, b=[]):\n    pass\n",
    "SELF_COMPARISON": "if a.b == a.b:\n    pass\n",
    "SHELL_CALL": "run(a, shell=True)\n",
    "YAML_LOAD": "yaml.load(a)\n",
    "OPEN_TASK": "x = 1  # TODO: tidy\n",
    "LONG_FUNCTION": "def tall():\n" + "    go()\n" * 60,
    "MANY_PARAMETERS": "def f(a, b, c, d, e, f, g):\n    pass\n",
    "UNREACHABLE": "def f():\n    return 1\n    go()\n",
    "REQUEST_TO_QUERY": "q = get_json()\ndb.executescript(q)\n",
}


def test_shipped_rules_find_their_example_and_nothing_in_plain_code():
    detect = rules.detector(rules.default_rules())
    assert {r.id for r in rules.default_rules()} == SHIPPED.keys()
    for rule, code in SHIPPED.items():
        assert rule in {f.name for f in detect(source(code)) if f.kind == "issue"}, rule
    plain = "import yaml\n\ndef f(a, b=None):\n    log(yaml.load(a, Loader=yaml.SafeLoader))\n    if a == b:\n        return run([a])\n"
    assert not [f for f in detect(source(plain)) if f.kind == "issue"]
