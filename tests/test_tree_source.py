"""The data source: what it lists and reads, what is pushed to it, and that only whole results are written."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.sources import tree_source
from codeloom.sources.trees import listed


@pytest.fixture
def tree(tmp_path):
    for k in range(12):
        for path in (f"src/p{k}/a{k}.py", f"src/p{k}/deep/er/b{k}.py", f"src/p{k}/notes.txt", f"src/p{k}/__pycache__/c.py", f"tests/test_{k}.py"):
            at = tmp_path / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(f"x = {k}\n" * (k + 1))
    (tmp_path / "venv/lib").mkdir(parents=True)
    (tmp_path / "venv/lib/no.py").write_text("no")
    (tmp_path / "top.py").write_bytes(b"a\r\nb\rc")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "_x.py").write_text("1")
    (tmp_path / "large.py").write_text("#" * 2_000_000)
    return tmp_path


def load(spark, path, **options):
    tree_source.register(spark)
    return spark.read.format("codeloom").options(**options).load(str(path))


def test_same_files_as_the_listing(spark, tree):
    rows = {r.path: r for r in load(spark, tree).collect()}
    assert sorted(rows) == listed(str(tree))
    assert rows[f"{tree}/top.py"].code == "a\nb\nc" and rows[f"{tree}/bad.py"].code is None and rows[f"{tree}/empty.py"].code == ""
    r = rows[f"{tree}/src/p3/a3.py"]
    assert (r.name, r.stem, r.suffix, r.size_bytes, r.code) == ("a3.py", "a3", ".py", 24, "x = 3\n" * 4)
    assert load(spark, tree / "top.py").count() == 1
    assert load(spark, tree, suffixes=".txt").count() == 12
    assert load(spark, tree, ignore="src/", largestKb="1").count() == 17
    assert load(spark, tree, suffixes=".none").count() == 0


def test_many_directories_are_dealt_out(tree):
    reader = tree_source.TreeReader({"path": str(tree)})
    shares = reader.partitions()
    assert len(shares) >= 1
    wide = tree_source.TreeReader({"path": str(tree)})
    old, tree_source.ENOUGH = tree_source.ENOUGH, 8
    try:
        shares = wide.partitions()
    finally:
        tree_source.ENOUGH = old
    assert sum(len(s.directories) for s in shares) == 12 and sorted(r[0] for s in shares for r in wide.read(s)) == listed(str(tree))


FILTERS = ["path like '{t}/src/p1%'", "size_bytes < 20", "size_bytes >= 20 and size_bytes < 60", "name = 'a3.py'", "name in ('a3.py', 'b4.py', 'test_5.py')", "suffix = '.py' and path like '%b7.py'", "code is null", "code like 'x = 3%'", "path = '{t}/tests/test_2.py'", "stem = 'top' or name = 'bad.py'", "not name = 'a3.py'"]


@pytest.mark.parametrize("where", FILTERS)
def test_filters_change_no_result(spark, tree, where):
    where = where.replace("{t}", str(tree))
    whole = load(spark, tree).collect()
    want = spark.createDataFrame(whole, tree_source.FILE).filter(where).select("path").collect()
    got = load(spark, tree).filter(where).select("path").collect()
    assert sorted(got) == sorted(want) and want


def test_filters_reach_the_reader(spark, tree):
    """A pushed filter is no longer in the plan, and directories outside of a prefix are not listed."""
    df = load(spark, tree).filter(F.col("path").startswith(f"{tree}/src/p1/") & (F.col("size_bytes") < 1000) & F.col("code").contains("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert "size_bytes" not in condition.replace("isnotnull(size_bytes", "") and "code" in condition
    reader = tree_source.TreeReader({"path": str(tree)})
    assert list(reader.pushFilters([tree_source.StringStartsWith(("path",), f"{tree}/src/p1/"), tree_source.StringStartsWith(("code",), "x")])) == [tree_source.StringStartsWith(("code",), "x")]
    seen, scan = [], reader._scan
    reader._scan = lambda d: seen.append(d) or scan(d)
    rows = [r for s in reader.partitions() for r in reader.read(s)]
    assert len(rows) == 2 and not any(d.startswith((f"{tree}/tests", f"{tree}/src/p2")) for d in seen)


def lines(folder):
    return sorted(json.loads(line)["id"] for name in os.listdir(folder) if name.endswith(".jsonl") for line in open(folder / name, encoding="utf-8"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    tree_source.register(spark)
    out = tmp_path / "out"
    ids = spark.range(100).repartition(4)
    ids.withColumn("text", F.lit("ä\n")).write.format("codeloom").mode("append").save(str(out))
    assert lines(out) == list(range(100)) and sorted(n for n in os.listdir(out) if not n.endswith(".jsonl")) == ["_SUCCESS"]
    broken = ids.select((F.col("id") + 100).alias("id"), F.expr("if(id = 77, raise_error('no'), 'x')").alias("text"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("codeloom").mode("append").save(str(out))
    assert lines(out) == list(range(100)) and "_drafts" not in os.listdir(out)
    ids.filter("id < 3").withColumn("text", F.lit(None).cast("string")).write.format("codeloom").mode("overwrite").save(str(out))
    assert lines(out) == [0, 1, 2]
