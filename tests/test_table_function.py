"""The table function gives what the engine gives, column by column, and refuses wrong names when a query is analyzed."""

import pytest

from codeloom.detect import engine, table_function

CODES = {"src/a.py": "password = 'hunter22!'\ndef f(x):\n    return eval(x)\n", "tests/test_b.py": "def test_it():\n    run()\n", "src/bad.py": "def (", "src/empty.py": "", "src/null.py": None}


@pytest.fixture
def files(spark):
    table_function.register(spark)
    df = spark.createDataFrame([(k, k, v) for k, v in CODES.items()], "file_id string, path string, code string")
    df.createOrReplaceTempView("files_of_test")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_facts_as_the_engine(spark, files):
    every = spark.sql("SELECT f.file_id, i.* FROM files_of_test f, LATERAL code_facts(f.code, f.path) i")
    want = engine.facts(files)
    assert rows(every.select(*want.columns)) == rows(want)
    part = spark.sql("SELECT f.file_id, i.* FROM files_of_test f, LATERAL code_facts(f.code, f.path, 'security, symbols', 'name, seq') i")
    assert part.columns == ["file_id", "name", "seq"]
    assert rows(part) == rows(engine.facts(files, "security", "symbols").select("file_id", "name", "seq"))


def test_wrong_names_fail_at_once(spark, files):
    for call, said in (("code_facts(f.code, f.path, 'no such')", "no such"), ("code_facts(f.code, f.path, 'style', 'colour')", "colour"), ("code_facts(f.code, f.path, f.path)", "constant")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT i.* FROM files_of_test f, LATERAL {call} i")
