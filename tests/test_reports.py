"""Source trees, reports, rewriting and the command line on small files."""

import json

import pytest

from codeloom import __main__ as cli
from codeloom.operators import project, render, rewrite
from codeloom.sources import trees

IGNORE = [
    (["dir/"], {"dir/a.py", "x/dir/a.py"}),
    (["/dir"], {"dir/a.py"}),
    (["**/venv/**"], {"venv/a.py", "x/venv/b/c.py"}),
    (["*.egg-info/**"], {"p.egg-info/a.py"}),
    (["a.py"], {"a.py", "dir/a.py", "x/dir/a.py", "venv/a.py", "p.egg-info/a.py"}),
    (["*.py", "!keep.py"], {"a.py", "dir/a.py", "x/dir/a.py", "venv/a.py", "x/venv/b/c.py", "p.egg-info/a.py", "b1.py"}),
    (["x/*.py"], set()),
    (["x/**/a.py"], {"x/dir/a.py"}),
    (["b[0-9].py", "# comment", ""], {"b1.py"}),
    (["b[!0-9].py"], set()),
    (["dir/", "!dir/a.py"], {"dir/a.py", "x/dir/a.py"}),
]
TREE = ["a.py", "b1.py", "keep.py", "dir/a.py", "x/dir/a.py", "venv/a.py", "x/venv/b/c.py", "p.egg-info/a.py"]


@pytest.mark.parametrize(("patterns", "gone"), IGNORE)
def test_ignored(patterns, gone):
    test = trees.ignores(patterns)
    assert {p for p in TREE if test(p)} == gone


@pytest.fixture
def tree(tmp_path):
    for name in ("src/__init__.py", "src/.hidden.py", "src/main.py", "venv/lib.py", "README.md", "tests/test_main.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if "init" in name else 'password = "hunter22"\r\nx = eval(y)\n' if "src/main" in name else "def test_it():\n    pass\n")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "big.py").write_text("#" * 3000)
    return tmp_path


def test_directory(spark, tree):
    with trees.source(spark, str(tree), largest_kb=2) as reader:
        got = {r["path"].removeprefix(f"{tree}/"): r["code"] for r in reader.files().collect()}
    assert set(got) == {"src/__init__.py", "src/.hidden.py", "src/main.py", "src/bad.py", "tests/test_main.py"}
    assert got["src/bad.py"] is None and got["src/main.py"] == 'password = "hunter22"\nx = eval(y)\n'


def test_single_file_and_unreadable_ones(spark, tree):
    with trees.source(spark, str(tree / "README.md")) as reader:
        assert [r["name"] for r in reader.files().collect()] == ["README.md"]
    rows = trees.read_files(spark, [str(tree / "gone.py"), str(tree / "big.py")]).collect()
    assert sorted((r["name"], r["size_bytes"]) for r in rows) == [("big.py", 3000), ("gone.py", None)]
    assert trees.read_files(spark, []).count() == 0


def test_sources_that_are_none(spark, tree):
    for at in (str(tree / "none"), "https://github.com/only"):
        with pytest.raises(trees.SourceError), trees.source(spark, at) as reader:
            reader.files()
    with trees.source(spark, "https://github.com/a/b", checkout=str(tree)) as reader:
        assert reader.files().count() == 6


def test_git_info(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/work\n")
    (git / "refs/heads/work").write_text("0123456789abcdef\n")
    (git / "config").write_text('[core]\n\tbare = false\n[remote "origin"]\n\turl = https://h.org/x\n')
    assert trees.git_info(str(tmp_path)) == {"branch": "work", "commit": "01234567", "remote": "https://h.org/x"}
    assert set(trees.git_info(str(git)).values()) == {None}


def test_analyze(spark, tree, tmp_path, capsys):
    (tmp_path / "rules.yaml").write_text("rules:\n- {id: own, name: Own, pattern: 'eval(', severity: low}\n")
    code = cli.analyze(spark, str(tree / "src"), str(tmp_path / "out"), str(tmp_path / "rules.yaml"))
    printed = capsys.readouterr().out
    assert code == 1 and "critical: Hardcoded password" in printed and "critical: Code injection via eval()" in printed
    report = render.load_report(str(tmp_path / "out/latest.json"))
    assert report["severities"]["critical"] == 2 and {i["title"] for i in report["issues"] if i["analyzer"] == "custom_rules"} == {"Own"}
    page = (tmp_path / "out/latest.html").read_text()
    assert "<h2>security</h2>" in page and "Hardcoded password" in page
    assert cli.analyze(spark, str(tree / "README.md")) == 0


def test_command_line(capsys, tmp_path):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    (tmp_path / "c.yaml").write_text("max_workers: 0\n")
    assert cli.main(["config-show", "--config", str(tmp_path / "c.yaml")]) == 2
    assert [cli.log_level(v) for v in (0, 1, 2, 9)] == [30, 20, 10, 10]


def test_html_escapes_and_says_how_many_more(spark):
    rows = [("a", "low", "a", f"<b{k}>", "f", k, k) for k in range(8)]
    issues = spark.createDataFrame(rows, "analyzer string, severity string, category string, title string, file_path string, line_number int, emit_seq long")
    shown = [r.asDict() for r in render.first_issues(issues).collect()]
    page = render.HtmlReporter("").text({"score": 1}, shown, {"low": 8}, {"a": ["x < y"]})
    assert "&lt;b0&gt;" in page and "<b0>" not in page and "... and 3 more" in page and "x &lt; y" in page
    assert json.loads(render.JsonReporter("").text({}, shown, {}, {}))["issues"][0]["more"] == 3


def test_docstrings():
    code = "class A:\n    def do_it(self):\n        return 1\n    def _no(self):\n        pass\ndef b(): pass\ndef c():\n    'doc'\n"
    got, n = rewrite.documented(code)
    assert n == 2 and got == 'class A:\n    """\n    A class.\n    """\n    def do_it(self):\n        """\n        Do it function.\n        """\n        return 1\n    def _no(self):\n        pass\ndef b(): pass\ndef c():\n    \'doc\'\n'
    assert rewrite.documented("def oops(:") == ("def oops(:", 0)


def test_replacements(spark):
    files = spark.createDataFrame([("a", "x\ny\nz"), ("b", "x"), ("c", None)], "file_id string, code string")
    fixes = spark.createDataFrame([("a", 1, "x", "X"), ("a", 3, "stale", "Z"), ("a", 9, "y", "Y"), ("a", 2, "y", "2"), ("a", 2, "y", "1"), ("d", 1, "x", "X")], "file_id string, line_number int, original string, replacement string")
    got = {r.file_id: (r.code, r.n_applied) for r in rewrite.apply_replacements(files, fixes).collect()}
    assert got == {"a": ("X\n1\nz", 2), "b": ("x", 0), "c": (None, 0)}


def test_complexity_insights(spark):
    wide = {"average_cyclomatic_complexity": 12.0, "max_cyclomatic_complexity": 30.0, "average_cognitive_complexity": 16.0, "max_nesting_depth": 6.0, "max_npath_complexity": 300.0, "average_essential_complexity": 1.0, "average_halstead_bugs": 0.25, "total_functions": 3.0}
    said = project.insights(spark.createDataFrame([tuple(wide.values())], list(wide)), "complexity").first()["insights"]
    assert said == [
        "High cyclomatic complexity (avg: 12.0). Refactoring recommended.",
        "High cognitive complexity (avg: 16.0). Difficult to understand.",
        "Low predicted defect rate (0.25 bugs per file).",
        "Excessive nesting detected (max: 6 levels).",
        "High NPATH complexity (300 paths). Testing will be challenging.",
        "Both cyclomatic and cognitive complexity are high. Immediate refactoring required.",
        "Analyzed 3 functions across project.",
    ]
