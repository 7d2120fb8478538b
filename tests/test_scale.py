"""What must hold for large tables: code is dealt to all cores and parsed once, and no join sends a table through the driver."""

from codeloom.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def once(text):
    assert text.count("MapInArrow") == 1 and "RoundRobinPartitioning" in text and "Join" not in text


def test_tests_are_parsed_once_by_all_cores(spark, data):
    once(plan(QUERIES["test_smells"](spark, data)))


def test_flows_are_parsed_once_by_all_cores(spark, data):
    once(plan(QUERIES["taint_flows"](spark, data)))


def test_names_over_files_are_joined_by_shuffles(spark, data, monkeypatch):
    """However small a written table is: compressed, it is a hundredth of what a broadcast would send."""
    from codeloom.operators import symbols, taint
    from codeloom.plans import across
    from codeloom.sources import store

    plans, stored = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: plans.append(plan(df)) or stored(df, name))
    found = across.kept_facts(spark, across.class_files(spark, data), "symbols", "flows").limit(300)
    resolved = symbols.resolve(symbols.references(found), found)
    above = symbols.ancestors(resolved)
    plans += [plan(x) for x in (symbols.coupling(resolved, found), symbols.broken_overrides(found, above), symbols.envied(resolved, found), taint.flows(found))]
    assert len(plans) > 12 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_new_files_are_told_from_known_ones_once(spark, monkeypatch):
    """Neither their facts nor their keys go back to the join that found them; more tasks write more keys."""
    import uuid

    from codeloom.sources import fact_store
    from codeloom.sources.store import shared_dir

    plans, write = [], fact_store.FactStore._write
    monkeypatch.setattr(fact_store.FactStore, "_write", lambda self, df, *more: plans.append(plan(df)) or write(self, df, *more))
    monkeypatch.setattr(fact_store, "TOGETHER", 10, raising=False)
    files = spark.range(1_000).selectExpr("cast(id as string) as file_id", "concat('m', id, '.py') as path", "concat('password = \"hunter', id, '!\"') as code")
    store = fact_store.FactStore(spark, f"{shared_dir(spark)}/codeloom/test-{uuid.uuid4().hex}", "security", splits=4)
    assert [(store.facts(files).filter("name = 'SECRET_PASSWORD'").count(), store.parsed) for _ in range(2)] == [(1_000, 1_000), (1_000, 0)]
    assert len(plans) == 2 and not any("Join" in p or "Aggregate" in p for p in plans)
    assert len(store._read("keys", "key string", store.folders()).inputFiles()) > 50


def test_equal_codes_are_judged_once(monkeypatch):
    """Where a detector looks at the path, each file is judged; a title still names its own file."""
    from codeloom.detect import engine, rules

    parsed, parse = [], engine.parse
    monkeypatch.setattr(engine, "parse", lambda *a: parsed.append(a) or parse(*a))
    code = "def f(a):\n" + "".join(f"{' ' * k}if a > {k}:\n" for k in range(1, 9)) + " " * 9 + "return a\n"
    known, chosen = engine.Known(), [(m.NAME, m.detect) for m in (engine.complexity, engine.readability)]
    got = {p: list(engine.facts_of("1", p, code, chosen, known)) for p in ("a/x.py", "b/y.py", "b/y.py")}
    assert len(parsed) == 1
    assert got == {p: list(engine.facts_of("1", p, code, chosen)) for p in got}
    assert any("y.py" in (f.title or "") for f in got["b/y.py"]) and not any("\0" in (f.title or "") for f in got["b/y.py"])
    parsed.clear()
    edges = [(engine.architecture.NAME, engine.architecture.detect)]
    scopes = [{f.scope for f in engine.facts_of("1", p, "import os\n", edges, known) if f.kind == "edge"} for p in ("a/x.py", "b/y.py")]
    assert scopes == [{"x"}, {"y"}] and len(parsed) == 1
    looks = [("own", lambda source: iter([engine.Fact("own", "issue", source.path)]))]
    assert [[f.name for f in engine.facts_of("1", p, "x = 1\n", looks, known)] for p in ("a/x.py", "b/y.py")] == [["a/x.py"], ["b/y.py"]]
    ruled = [("custom_rules", rules.detector([rules.Rule.load({"id": "r", "name": "R", "pattern": "eval(", "exclude_paths": ["src/"]})], taint=False, smells=False))]
    parsed.clear()
    assert [len(list(engine.facts_of("1", p, "eval(x)\n", ruled, known))) for p in ("a.py", "src/a.py", "b.py", "src/b.py")] == [1, 0, 1, 0] and len(parsed) == 2
    broken = [list(engine.facts_of(p, p, "def f(:\n", chosen, known)) for p in ("a", "b")]
    assert broken[0] == broken[1] and broken[0][0].kind == "parse_error"


def test_kept_codes_are_bounded():
    from codeloom.detect.engine import Known

    known = Known(10)
    for k in range(100):
        known.keep(f"x{k}", [k] * 2, 2)
        assert known.get("x0" if k < 3 else f"x{k}") is not None and known.size <= 10
    known.keep("big", [0] * 50, 50)
    assert known.get("big") is None and known.get("x99") == [99, 99] and known.get("x1") is None
