"""Queries over many files at once: names, classes and taint that cross files, facts kept between runs. A file imports the one whose
number is a third of its own, or follows a fixed step, so SQL can follow the same ways by recursion."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detect import engine, rules, table_function
from ..operators import many_rules, project, similar, symbols, taint
from ..sources.fact_store import FactStore
from ..sources.store import shared_dir
from ..sources.tables import documents_as_files, spread, table
from . import mosaic, pieces
from .queries import query


def _files(spark: SparkSession, d: str, code: Column, directory: str) -> DataFrame:
    """A file for each row of part. code: a column over p, its key."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    key = F.col("p").cast("string")
    return spread(part).select(key.alias("file_id"), F.concat(F.lit(f"src/{directory}/m"), key, F.lit(".py")).alias("path"), code.alias("code"))


@cache
def _session_store(spark: SparkSession, app: str) -> str:
    return f"{shared_dir(spark)}/codeloom/facts-{app}"


def kept_facts(spark: SparkSession, files: DataFrame, *detectors: str) -> DataFrame:
    """Facts by a store of the session: queries on the same files parse them once."""
    return FactStore(spark, _session_store(spark, spark.sparkContext.applicationId), *detectors).facts(files)


def _text(template: str, q: Column) -> Column:
    """A template's {q} replaced by a number."""
    return F.replace(F.lit(template), F.lit("{q}"), q.cast("string"))


# --- names over files ---------------------------------------------------------------------------------------------

#: By p % 5: how a file gets the class Box of file p // 3, and what it makes of it. File 0 has the root.
CLASSES = (
    "from pkg.m{q} import Box as Base\nclass Box(Base):\n    def run(self, a, b):\n        return a\n",
    "import pkg.m{q} as other\nclass Box(other.Box):\n    def run(self, a):\n        raise NotImplementedError()\n",
    "from pkg.m{q} import Box\n",
    "from .m{q} import Box as Up\nclass Box(Up):\n    pass\nclass Other:\n    def use(self, box: Up):\n        return Up().run(box.a, box.b, box.c, box.d)\n",
    "import os, pkg.m{q}\nclass Box(pkg.m{q}.Box, os.PathLike):\n    def run(self, a, b, *more):\n        return self.run(a, b)\n",
)
ROOT = "class Box:\n    def run(self, a, b):\n        return a\n"
#: base: the file whose class a file's Box inherits from, imports followed through files that only hand it on
BASE = """WITH RECURSIVE b AS (SELECT p_partkey AS p, p_partkey // 3 AS place FROM part WHERE p_partkey > 0 AND p_partkey % 5 <> 2 UNION ALL SELECT p, place // 3 FROM b WHERE place > 0 AND place % 5 = 2),
 base AS (SELECT p, min(place) AS q FROM b GROUP BY p)"""


def class_files(spark, d):
    p = F.col("p")
    code = F.lit(ROOT)
    for k, text in enumerate(CLASSES):
        code = F.when((p > 0) & (p % 5 == k), _text(text, F.floor(p / 3))).otherwise(code)
    return _files(spark, d, code, "pkg")


@cache
def class_names(spark, d):
    """Facts and resolved names, once for a session and folder."""
    found = kept_facts(spark, class_files(spark, d), "symbols")
    return found, symbols.resolve(symbols.references(found), found)


@query(f"""{BASE} SELECT CAST(p AS VARCHAR) AS file_id, 'Box' AS name, CAST(q AS VARCHAR) AS base_file, 'Box' AS base, NULL AS external FROM base
 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Box', NULL, NULL, 'os.PathLike' FROM part WHERE p_partkey > 0 AND p_partkey % 5 = 4""")
def class_bases(spark, d):
    return symbols.bases(class_names(spark, d)[1])


@query(f"""{BASE}, up AS (SELECT p, q, 1 AS depth FROM base UNION ALL SELECT up.p, base.q, depth + 1 FROM up JOIN base ON up.q = base.p)
 SELECT CAST(p AS VARCHAR) AS file_id, 'Box' AS name, CAST(q AS VARCHAR) AS ancestor_file, 'Box' AS ancestor, CAST(depth AS INTEGER) AS depth FROM up""")
def class_ancestors(spark, d):
    return symbols.ancestors(class_names(spark, d)[1])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file_id, 'Box' AS name, CASE WHEN p_partkey = 0 THEN 0 ELSE 1 END AS coupled, CASE WHEN p_partkey > 0 AND p_partkey % 5 IN (1, 4) THEN 1 ELSE 0 END AS outside FROM part WHERE p_partkey = 0 OR p_partkey % 5 <> 2
 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Other', 1, 0 FROM part WHERE p_partkey % 5 = 3""")
def class_coupling(spark, d):
    found, resolved = class_names(spark, d)
    return symbols.coupling(resolved, found)


@query(f"""{BASE}, near AS (SELECT p, q FROM base WHERE p % 5 <> 3 UNION ALL SELECT near.p, base.q FROM near JOIN base ON near.q = base.p WHERE near.q % 5 = 3 AND near.q > 0),
 pairs AS (SELECT p, min(q) AS q FROM near GROUP BY p), kinds AS (SELECT p, q, p % 5 AS k, CASE WHEN q = 0 THEN 0 ELSE q % 5 END AS m FROM pairs)
 SELECT CAST(p AS VARCHAR) AS file_id, 'Box.run' AS name, 3 AS line_number, CAST(q AS VARCHAR) AS base_file, 'Box.run' AS base,
 CASE WHEN k = 1 THEN 'refused' WHEN m = 1 THEN 'demands' ELSE 'rejects' END AS reason FROM kinds WHERE (k = 1 AND m <> 1) OR (k <> 1 AND m = 1) OR (k = 0 AND m = 4)""")
def class_overrides(spark, d):
    found, resolved = class_names(spark, d)
    return symbols.broken_overrides(found, symbols.ancestors(resolved))


@query(f"""{BASE} SELECT CAST(p AS VARCHAR) AS file_id, 'Other.use' AS name, 'box' AS parameter, CAST(q AS VARCHAR) AS target_file, 'Box' AS target, 4 AS touched, 0 AS own FROM base WHERE p % 5 = 3""")
def class_envy(spark, d):
    found, resolved = class_names(spark, d)
    return symbols.envied(resolved, found)


# --- taint over files ---------------------------------------------------------------------------------------------

#: By p % 6: what a file's step does with its argument. It imports the step of file (7 p + 3) % n as nxt.
STEPS = (
    "def step(x):\n    return x\n",
    "def step(x):\n    return escape(nxt(x))\n",
    "def step(x):\n    y = 'a' + nxt(x)\n    return y\n",
    "def step(x):\n    return nxt('fixed')\n",
    "def step(x):\n    if x:\n        return nxt(x)\n    return step(x)\n",
    "def step(x):\n    db.execute(nxt(x))\n    return 'fixed'\n",
)
MAIN = "from chain.m{q} import step as nxt\ndef main():\n    data = input()\n    os.system(step(data))\n"


def step_files(spark, d):
    p = F.col("p")
    n = table(spark, d, "part").count()
    code = F.lit("")
    for k, text in enumerate(STEPS):
        code = F.when(p % 6 == k, F.lit(text)).otherwise(code)
    return _files(spark, d, F.concat(_text(MAIN, (p * 7 + 3) % n), code), "chain")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS p, p_partkey % 6 AS k, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS q FROM part),
 passes AS (SELECT p FROM n WHERE k = 0 UNION SELECT n.p FROM n JOIN passes ON n.q = passes.p WHERE n.k IN (2, 4)),
 arrives AS (SELECT p, p AS place FROM n UNION SELECT a.p, n.q FROM arrives a JOIN n ON a.place = n.p WHERE n.k IN (1, 2, 4, 5)),
 hits AS (SELECT a.p, a.place, 6 AS line, 'db.execute' AS sink, 'sql' AS kind FROM arrives a JOIN n ON a.place = n.p WHERE n.k = 5 AND n.q IN (SELECT p FROM passes) UNION ALL SELECT p, p, 4, 'os.system', 'command' FROM passes)
 SELECT CAST(p AS VARCHAR) AS source_file, 3 AS source_line, 'input' AS source, CAST(place AS VARCHAR) AS sink_file, line AS sink_line, sink, kind, 'critical' AS severity FROM hits""")
def taint_across_files(spark, d):
    return taint.flows(kept_facts(spark, step_files(spark, d), "symbols", "flows"))


# --- facts kept between runs --------------------------------------------------------------------------------------

OLD, NEW = "def f(a):\n    password = 'hunter22!'\n    return a\n", "def f(a):\n    return a\n"


@query("""WITH p AS (SELECT p_partkey AS p, count(*) OVER () AS n FROM part), runs AS (SELECT unnest(range(4)) AS run),
 f AS (SELECT run, p, CASE WHEN run >= 2 AND p % 50 = 1 THEN 'new' ELSE 'old' END AS kind FROM p JOIN runs ON run < 3 OR p % 7 <> 0)
 SELECT run, count(*) AS files, CASE run WHEN 0 THEN count(*) WHEN 2 THEN count(*) FILTER (kind = 'new') ELSE 0 END AS parsed, count(*) FILTER (kind = 'old') AS secrets FROM f GROUP BY run""")
def facts_between_runs(spark, d):
    """First run, the same again, one file in fifty changed, one in seven gone."""
    store = FactStore(spark, f"{shared_dir(spark)}/codeloom/facts-{uuid.uuid4().hex}", "security")
    p = F.col("p")
    rows = []
    for run in range(4):
        code = F.when((p % 50 == 1) & F.lit(run >= 2), F.lit(NEW)).otherwise(F.lit(OLD))
        files = _files(spark, d, code, "kept")
        found = store.facts(files if run < 3 else files.filter("cast(file_id as long) % 7 <> 0"))
        secrets = found.filter("kind = 'issue' and name = 'SECRET_PASSWORD'").count()
        rows.append((run, store.files, store.parsed, secrets))
    return spark.createDataFrame(rows, "run long, files long, parsed long, secrets long")


# --- what could not be judged -------------------------------------------------------------------------------------

#: A file that does not parse, one that is deep, one that is too deep for the parser, one that is as it should be
SHAPES = ("def f(:\n", "password = 'hunter22!'\nx = " + " + ".join(["'a'"] * 5_000) + "\n", "password = 'hunter22!'\nx = " + " + ".join(["'a'"] * 30_000) + "\n", "x = 1\n")


@query("""SELECT CASE WHEN p_partkey % 40 = 0 THEN 'syntax' WHEN p_partkey % 40 = 2 THEN 'too deep' ELSE 'parsed' END AS state, count(*) AS files, count(*) FILTER (p_partkey % 40 IN (1, 2)) AS secrets, 0 AS failures FROM part GROUP BY 1""")
def analysis_health(spark, d):
    p = F.col("p") % 40
    code = F.when(p < 3, F.element_at(F.array(*map(F.lit, SHAPES[:3])), p.cast("int") + 1)).otherwise(F.lit(SHAPES[3]))
    files = _files(spark, d, code, "odd")
    each = project.health(files, engine.facts(files, "security", "complexity"))
    return each.groupBy("state").agg(F.count("*").alias("files"), F.count_if(F.col("issues") > 0).alias("secrets"), F.sum("failures").alias("failures"))


# --- pairs over files ---------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT DISTINCT event_type || '_' || CAST(hour(ts) AS VARCHAR) || '_' || CAST(user_id % 10 AS VARCHAR) AS name FROM events)
 SELECT x.name AS a, y.name AS b, CAST(levenshtein(x.name, y.name) AS INTEGER) AS distance FROM w x JOIN w y ON x.name < y.name WHERE levenshtein(x.name, y.name) <= least(2, least(length(x.name), length(y.name)) // 3)""")
def names_similar_in_project(spark, d):
    name = F.concat_ws("_", "event_type", F.hour("ts").cast("string"), (F.col("user_id") % 10).cast("string"))
    return similar.similar_names(table(spark, d, "events").select(name.alias("name")))


#: A test of a file has so many of each of these statements
STATEMENTS = ((" assert x\n", "p % 7"), (" work()\n", "p % 5 + 1"), (" y = 1\n", "p % 3"))
#: What one of each adds to the shape
EDGES_OF = ({"FunctionDef>Assert": 1, "Assert>Name": 1, "Name>Load": 1}, {"FunctionDef>Expr": 1, "Expr>Call": 1, "Call>Name": 1, "Name>Load": 1}, {"FunctionDef>Assign": 1, "Assign>Name": 1, "Assign>Constant": 1, "Name>Store": 1})
_COUNTS = {edge: " + ".join(["0", *(f"{c}.{n}" for n, of in zip("xyz", EDGES_OF) if edge in of for c in ("{t}",))]) for of in EDGES_OF for edge in of}
_BOTH = {how: " + ".join(["1", *(f"{how}({c.format(t='a')}, {c.format(t='b')})" for c in _COUNTS.values())]) for how in ("least", "greatest")}


@query(f"""WITH t AS (SELECT p_partkey AS p, p_partkey % 7 AS x, p_partkey % 5 + 1 AS y, p_partkey % 3 AS z FROM part), c AS (SELECT x, y, z, min(CAST(p AS VARCHAR)) AS file_id, count(*) AS n FROM t GROUP BY 1, 2, 3),
 pairs AS (SELECT a.file_id AS f, b.file_id AS g, a.n AS n, b.n AS m, {_BOTH['least']} AS shared, {_BOTH['greatest']} AS every FROM c a JOIN c b ON a.file_id < b.file_id)
 SELECT f AS file_id, g AS other_file, n AS tests, m AS other_tests, CAST(shared AS INTEGER) AS shared, CAST(every AS INTEGER) AS "all" FROM pairs WHERE 100 * shared >= 80 * every""")
def tests_duplicated_across_files(spark, d):
    """Pairs of classes of tests, each by its least file and its size."""
    body = [F.repeat(F.lit(text), F.expr(n).cast("int")) for text, n in STATEMENTS]
    found = engine.facts(_files(spark, d, F.concat(F.lit("def test_it():\n"), *body), "tests"), "test_shapes")
    members, pairs = similar.duplicated_tests(similar.shapes(found))
    each = members.groupBy("class").agg(F.min("file_id").alias("file_id"), F.count("*").alias("tests"))
    both = pairs.join(each, "class").join(each.select(F.col("class").alias("other"), F.col("file_id").alias("other_file"), F.col("tests").alias("other_tests")), "other")
    swapped = lambda a, b: F.when(F.col("file_id") < F.col("other_file"), F.col(a)).otherwise(F.col(b))
    return both.select(F.least("file_id", "other_file").alias("file_id"), F.greatest("file_id", "other_file").alias("other_file"), swapped("tests", "other_tests").alias("tests"), swapped("other_tests", "tests").alias("other_tests"), "shared", "all")


#: Words that begin with two letters and hold -in-, and lines that begin with a capital
LETTERS = "aehinorst"
MANY = [{"id": f"{a}{b}", "pattern": rf"\b{a}{b}[a-z]*in"} for a in LETTERS for b in LETTERS] + [{"id": "capital", "pattern": "^[A-Z]", "excludes": ["the"]}]


@query("""WITH rules AS (SELECT a || b AS rule_id, '\\b' || a || b || '[a-z]*in' AS pattern FROM (SELECT unnest(string_split('aehinorst', '')) AS a), (SELECT unnest(string_split('aehinorst', '')) AS b)),
 lines AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
 hits AS (SELECT rule_id, file_id FROM rules JOIN lines ON regexp_matches(line, pattern) UNION ALL SELECT 'capital', file_id FROM lines WHERE regexp_matches(line, '^[A-Z]') AND NOT contains(line, 'the'))
 SELECT rule_id, count(*) AS hits, count(DISTINCT file_id) AS files FROM hits GROUP BY 1""")
def rules_many(spark, d):
    found = many_rules.many_hits(documents_as_files(spark, d), MANY)
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files"))


#: Calls with a first argument and a keyword, calls by their last argument, and comparisons of two calls
TREES = [
    rules.Rule.load({"type": "structure", **r})
    for r in (
        *({"id": f"first_{a}_{b}", "pattern": f"call_{a}({b}, ..., key=$V)", "message": "$V"} for a in range(20) for b in range(11)),
        *({"id": f"last_{a}_{c}", "pattern": f"call_{a}(..., $N, k{c})", "message": "$N"} for a in range(20) for c in range(4)),
        {"id": "same", "pattern": "$X == $X", "message": "$X"},
        {"id": "differ", "patterns-all": ["$F(y, $N, ...) == $G(y, $N, ...)", "$X == $Y"], "patterns-not": ["$X == $X"], "message": "$N"},
    )
]


@query("""WITH p AS (SELECT p_partkey AS p FROM part), hits AS (SELECT 'first_' || (p % 20) || '_' || (p % 11) AS rule_id, 'k' || (p % 4) AS detail FROM p
 UNION ALL SELECT 'last_' || (p % 20) || '_' || (p % 4), CAST(p % 7 AS VARCHAR) FROM p UNION ALL SELECT 'last_' || (p % 13) || '_' || (p % 5), CAST(p % 7 AS VARCHAR) FROM p WHERE p % 5 < 4
 UNION ALL SELECT 'same', 'call_' || (p % 20) || '(y, ' || (p % 7) || ', k' || (p % 4) || ')' FROM p WHERE p % 20 = p % 13 AND p % 4 = p % 5
 UNION ALL SELECT 'differ', CAST(p % 7 AS VARCHAR) FROM p WHERE p % 20 <> p % 13 OR p % 4 <> p % 5)
 SELECT rule_id, detail, count(*) AS hits FROM hits GROUP BY 1, 2""")
def rules_many_trees(spark, d):
    mod = lambda n: (F.col("p") % n).cast("string")
    call = lambda a, c: F.concat(F.lit("call_"), mod(a), F.lit("(y, "), mod(7), F.lit(", k"), mod(c), F.lit(")"))
    code = F.concat(F.lit("def f(y):\n    call_"), mod(20), F.lit("("), mod(11), F.lit(", y, key=k"), mod(4), F.lit(")\n    return "), call(20, 4), F.lit(" == "), call(13, 5), F.lit("\n"))
    found = engine.facts(_files(spark, d, code, "trees"), extra={"custom_rules": rules.detector(TREES, taint=False, smells=False)})
    return engine.issues(found).groupBy("rule_id", "detail").agg(F.count("*").alias("hits"))


# --- detectors from SQL -------------------------------------------------------------------------------------------


@query(mosaic.found_sql(pieces.SECURITY, lambda rule: rule.startswith(("SECRET_", "CRYPTO_"))))
def facts_by_sql(spark, d):
    """Findings of a SQL text."""
    table_function.register(spark)
    files = mosaic.files(spark, d, pieces.SECURITY)
    return spark.sql(
        """SELECT f.file_id, i.name AS rule_id, i.severity, i.title, i.line_number FROM {files} f,
        LATERAL code_facts(f.code, f.path, detectors => 'security', columns => 'kind, name, severity, title, line_number') i WHERE i.kind = 'issue' AND i.name RLIKE '^(SECRET|CRYPTO)_'""",
        files=files,
    )
