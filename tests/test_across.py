"""Names, classes and taint over several files on hand-made projects, and facts kept between runs."""

import uuid

import pytest
from pyspark.sql import functions as F

from codeloom.detect import engine, flows, symbols as names_of_file
from codeloom.operators import symbols, taint
from codeloom.sources.fact_store import FactStore
from codeloom.sources.store import shared_dir

PROJECT = {
    "src/pkg/__init__.py": "from .base import Root as Top\nfrom .more import *\n",
    "src/pkg/base.py": "class Root:\n  def run(self, a): return a\n  def stop(self, a, b=1): self.run(a)\nclass Other: pass\n",
    "src/pkg/more.py": "class Deep:\n  pass\n",
    "src/app.py": "import pkg\nimport pkg.base as b\nfrom pkg import Top, Deep\nfrom os import path\nclass Root(b.Root):\n  def run(self, a, c): raise NotImplementedError()\nclass C(Top, Deep, path.X):\n  def go(self, x: b.Other, y: 'str'):\n    self.run(1); x.a; x.b; x.c; x.d; pkg.base.Other(); helper()\n  def stop(self, a): pass\ndef helper(): return C()\nclass D(Root): pass\n",
    "src/loop.py": "from loop2 import Z\nclass Q(Z): pass\nclass Self(Self): pass\n",
    "src/loop2.py": "from loop import Z\n",
    "src/broken.py": "def (",
    "src/empty.py": "",
}


def files(spark, project):
    return spark.createDataFrame([(k, k, v) for k, v in project.items()], "file_id string, path string, code string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def project(spark):
    found = engine.facts(files(spark, PROJECT), "symbols").cache()
    resolved = symbols.resolve(symbols.references(found), found).cache()
    return found, resolved, symbols.ancestors(resolved).cache()


def test_names_are_resolved_through_aliases_packages_and_stars(project):
    got = {(r.file_id, r.scope, r.written): (r.target_file, r.target, r.target_role, r.external) for r in project[1].collect()}
    assert got["src/app.py", "Root", "b.Root"] == ("src/pkg/base.py", "Root", "class", None)
    assert got["src/app.py", "C", "Top"] == ("src/pkg/base.py", "Root", "class", None)
    assert got["src/app.py", "C", "Deep"] == ("src/pkg/more.py", "Deep", "class", None)
    assert got["src/app.py", "C", "path.X"] == (None, None, None, "os.path.X")
    assert got["src/app.py", "C.go", "pkg.base.Other"] == ("src/pkg/base.py", "Other", "class", None)
    assert got["src/app.py", "C.go", "helper"] == ("src/app.py", "helper", "function", None)
    assert got["src/app.py", "D", "Root"] == ("src/app.py", "Root", "class", None)
    # a name that two files only hand to each other is nobody's
    assert got["src/loop.py", "Q", "Z"][:3] == (None, None, None)


def test_classes_of_one_name_stay_apart(project):
    found, resolved, above = project
    assert rows(above.filter("file_id = 'src/app.py'"), "name", "ancestor_file", "ancestor", "depth") == [
        ("C", "src/pkg/base.py", "Root", 1), ("C", "src/pkg/more.py", "Deep", 1), ("D", "src/app.py", "Root", 1), ("D", "src/pkg/base.py", "Root", 2), ("Root", "src/pkg/base.py", "Root", 1),
    ]
    assert above.filter("file_id = 'src/loop.py'").count() == 0
    assert rows(symbols.coupling(resolved, found), "file_id", "name", "coupled", "outside") == [
        ("src/app.py", "C", 3, 1), ("src/app.py", "D", 1, 0), ("src/app.py", "Root", 1, 1), ("src/loop.py", "Q", 0, 1), ("src/loop.py", "Self", 0, 0),
        ("src/pkg/base.py", "Other", 0, 0), ("src/pkg/base.py", "Root", 0, 0), ("src/pkg/more.py", "Deep", 0, 0),
    ]


def test_own_calls_overrides_and_envy(project):
    found, resolved, above = project
    assert rows(symbols.own_calls(resolved, found, above), "file_id", "scope", "target_file", "target") == [("src/app.py", "C.go", "src/pkg/base.py", "Root.run"), ("src/pkg/base.py", "Root.stop", "src/pkg/base.py", "Root.run")]
    assert rows(symbols.broken_overrides(found, above), "name", "base_file", "base", "reason") == [("C.stop", "src/pkg/base.py", "Root.stop", "rejects"), ("Root.run", "src/pkg/base.py", "Root.run", "refused")]
    assert rows(symbols.envied(resolved, found), "name", "parameter", "target", "touched", "own") == [("C.go", "x", "Other", 4, 1)]


def test_module_names():
    known = {"src/a/b.py": "a.b", "a/__init__.py": "a", "src/__init__.py": "__init__", "./x.py": "x", "lib/x.py": "x", "src.py": "src", "__init__.py": "__init__"}
    assert {p: names_of_file.module_of(p) for p in known} == known
    assert [names_of_file.absolute(m, pkg, level, n) for m, pkg, level, n in (("a.b.c", False, 1, "d"), ("a.b.c", False, 2, None), ("a.b", True, 1, "d"), ("a.b", True, 2, "d"), ("a", False, 0, "z"))] == ["a.b.d", "a", "a.b.d", "a.d", "z"]


FLOWING = {
    "src/a.py": "from b import middle\nimport c as other\ndef main():\n    data = input()\n    if data:\n        data = escape(data)\n    text = middle('x', value=data)\n    db.execute(text)\n    other.store(request.args)\n    clean_one = escape(middle('x', data))\n    db.execute(clean_one)\n    eval(middle(data, 1))\n",
    "src/b.py": "from c import *\ndef middle(drop, value):\n    return last(value)\n",
    "src/c.py": "def last(v):\n    for k in range(3):\n        v = last(v + 'a')\n    return v\ndef store(rows):\n    pickle.loads(rows)\ndef get():\n    return input()\nclass K:\n    def put(self, q):\n        self.q = q\n        os.system(self.q)\n    def go(self):\n        self.put(get())\n",
    "src/d.py": "def ping(x):\n    return pong(x)\ndef pong(x):\n    return ping(x)\ndef end():\n    os.system(ping(input()))\n    os.system(strip(input()))\n",
}
EXPECTED = [
    ("src/a.py", 4, "input", "src/a.py", 8, "db.execute", "sql", "critical"), ("src/a.py", 9, "request.args", "src/c.py", 6, "pickle.loads", "pickle", "high"),
    ("src/c.py", 8, "input", "src/c.py", 12, "os.system", "command", "critical"), ("src/d.py", 7, "input", "src/d.py", 7, "os.system", "command", "critical"),
]


def test_taint_through_functions_files_methods_and_recursion(spark):
    """Through two helpers in two files, by keyword; into a sink of another file; out of one and into a method; a recursion without
    a way out hands nothing on and ends; sanitizers and parameters that are dropped stop it."""
    found = engine.facts(files(spark, FLOWING), "symbols", "flows").cache()
    columns = ("source_file", "source_line", "source", "sink_file", "sink_line", "sink", "kind", "severity")
    assert rows(taint.flows(found), *columns) == EXPECTED
    assert rows(taint.issues(found), "file_id", "rule_id", "line_number") == [("src/a.py", "TAINT_SQL", 8), ("src/c.py", "TAINT_COMMAND", 12), ("src/c.py", "TAINT_PICKLE", 6), ("src/d.py", "TAINT_COMMAND", 7)]


LOCAL = {
    "x = input()\nx = 1\nos.system(x)\n": 0,
    "x = input()\nif y:\n    x = 1\nos.system(x)\n": 1,
    "x = 1\nwhile y:\n    os.system(x)\n    x = input()\n": 1,
    "for x in sys.argv:\n    os.system(x)\n": 1,
    "with input() as x:\n    os.system(x)\n": 1,
    "try:\n    x = input()\n    x = 1\nexcept E:\n    pass\nos.system(x)\n": 0,
    "try:\n    x = input()\nfinally:\n    os.system(x)\n": 1,
    "a, (b, *c) = input()\nos.system(c)\n": 1,
    "d = {}\nd['k'] = input()\nos.system(d)\n": 1,
    "x = [y for y in input()]\nos.system(x)\n": 1,
    "if (n := input()):\n    os.system(n)\n": 1,
    "match input():\n    case [x, *_]:\n        os.system(x)\n": 1,
    "x = input() == 'a'\nos.system(x)\n": 0,
    "x = input()\nx += 'a'\nos.system(x)\n": 1,
}


@pytest.mark.parametrize("code", LOCAL)
def test_flows_within_a_body(code):
    got = [f for f in flows.detect(engine.parse("a", "a.py", code)) if f.name.startswith("s|") and f.detail.startswith("k|")]
    assert bool(got) == bool(LOCAL[code])


def test_deep_flows():
    code = "x = input()\ny = " + " + ".join(["x"] * 4_000) + "\nos.system(y)\nif a:\n    pass\n" + "".join(f"elif a == {k}:\n    pass\n" for k in range(1_500))
    assert any(f.detail.startswith("k|command") for f in flows.detect(engine.parse("a", "a.py", code)))


# --- facts kept between runs --------------------------------------------------------------------------------------


def same(a, b):
    """Equal facts, apart from the numbers of keys."""
    return rows(a, *a.columns) == rows(b, *b.columns)


def store_of(spark, *detectors, at=None, **more):
    return FactStore(spark, at or f"{shared_dir(spark)}/codeloom/test-{uuid.uuid4().hex}", *detectors, **more)


def test_only_new_content_is_parsed(spark):
    store = store_of(spark, "security", "complexity")
    codes = {f"src/f{k}.py": f"password = 'hunter{k}!'\n" for k in range(12)} | {"src/broken.py": "def (", "src/empty.py": "", "src/same.py": "x = 1\n"}
    first = files(spark, codes)
    assert same(store.facts(first), engine.facts(first, "security", "complexity")) and store.parsed == len(codes)
    assert same(store.facts(first), engine.facts(first, "security", "complexity")) and store.parsed == 0
    changed = files(spark, codes | {"src/f3.py": "password = 'another'\n"})
    assert same(store.facts(changed), engine.facts(changed, "security", "complexity")) and store.parsed == 1
    fewer = changed.filter("file_id <> 'src/f4.py'")
    assert same(store.facts(fewer), engine.facts(fewer, "security", "complexity")) and store.parsed == 0
    # another table with the same files under other ids, one of them twice, and a null
    other = first.select(F.concat(F.lit("z"), "file_id").alias("file_id"), "path", "code").unionByName(first.limit(1)).unionByName(spark.createDataFrame([("n", None, None)], first.schema))
    assert same(store.facts(other), engine.facts(other, "security", "complexity")) and store.parsed == 0


def test_other_detectors_or_versions_share_nothing(spark):
    store = store_of(spark, "security")
    table = files(spark, {"a.py": "password = 'hunter1!'\n"})
    store.facts(table)
    for again, parsed in ((store_of(spark, "security", at=store.path), 0), (store_of(spark, "style", at=store.path), 1), (store_of(spark, "security", at=store.path, version="x"), 1)):
        again.facts(table)
        assert again.parsed == parsed


def test_a_run_that_breaks_off_leaves_no_trace(spark, monkeypatch):
    store = store_of(spark, "security")
    table = files(spark, {"a.py": "password = 'hunter1!'\n"})
    monkeypatch.setattr(store, "_commit", lambda folders: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.facts(table)
    monkeypatch.undo()
    assert store.folders() == []
    assert same(store.facts(table), engine.facts(table, "security")) and store.parsed == 1


def test_compaction_deletes_what_is_gone(spark):
    store = store_of(spark, "security")
    table = files(spark, {f"f{k}.py": f"password = 'hunter{k}!'\n" for k in range(6)})
    store.facts(table.filter("file_id < 'f3.py'"))
    store.facts(table)
    assert len(store.folders()) == 2
    left = table.filter("file_id > 'f1.py'")
    assert store.compact(left) == 2 and len(store.folders()) == 1
    assert same(store.facts(left), engine.facts(left, "security")) and store.parsed == 0
    assert same(store.facts(table), engine.facts(table, "security")) and store.parsed == 2
