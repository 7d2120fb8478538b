"""Many tree patterns in one walk against one rule at a time."""

import ast
import pickle
import random
import time

from codeloom.detect import engine, rules
from codeloom.detect.pattern_tree import PatternTree

NAMES = ("a", "b", "c", "f", "g")


def expression(rng, depth, holes=()):
    """A random expression; of a pattern, with holes."""
    if holes and rng.random() < 0.25:
        return rng.choice(holes)
    if not depth or rng.random() < 0.2:
        return rng.choice((*NAMES, "1", "1.0", "True", "'s'", "None", "0.0", "-1", "b'x'", "u'u'"))
    sub = lambda: expression(rng, depth - 1, holes)
    some = lambda: ", ".join([sub() for _ in range(rng.randrange(4))] + (["..."] if holes and rng.random() < 0.3 else []))
    return rng.choice((
        lambda: f"{rng.choice(NAMES)}({some()})", lambda: f"f({sub()}, k={sub()})", lambda: f"({sub()} == {sub()})", lambda: f"({sub()} + {sub()} * {sub()})",
        lambda: f"[{some()}]", lambda: f"({sub()}, {sub()})", lambda: f"({sub()}).go({some()})", lambda: f"({sub()} if {sub()} else {sub()})", lambda: f"({sub()})[{sub()}]",
        lambda: f"{{{sub()}: {sub()}, **{sub()}}}", lambda: f"[{sub()} for a in {sub()}]", lambda: f"(lambda x, y=1: {sub()})", lambda: f"g(..., {sub()}, ...)", lambda: f"f'{{{rng.choice(NAMES)}}}'",
    ))()


def statement(rng, depth, holes=()):
    sub = lambda: expression(rng, depth, holes)
    body = "..." if holes and rng.random() < 0.6 else sub()
    return rng.choice((lambda: f"a = {sub()}", lambda: f"return {sub()}", lambda: f"if {sub()}:\n    {body}\nelse:\n    {sub()}", lambda: f"for b in {sub()}:\n    {body}", lambda: f"def f(a, b=1):\n    {body}\n    {sub()}", lambda: "return", sub))()


def one_at_a_time(given, source):
    """A rule's facts, as its tests find them at every node."""
    return {k: found for k, rule in enumerate(given) if (found := list(rules.by_tree(rule, source)))}


def test_the_same_matches_and_captures_as_one_rule_at_a_time():
    rng, holes = random.Random(11), ("$X", "$Y", "$Z", "...")
    pattern = lambda: statement(rng, 2, holes) if rng.random() < 0.4 else expression(rng, 2, holes)
    given = []
    for k in range(500):
        rule = {"id": str(k), "type": "structure", "message": "$X|$Y|$Z", "pattern": pattern() if k % 4 < 2 else ""}
        rule |= {"patterns-any": [pattern(), pattern()]} if k % 4 == 2 else {}
        rule |= {"patterns-all": ["$X", pattern()] if k % 8 == 3 else [pattern(), "$Y"]} if k % 4 == 3 else {}
        rule |= {"patterns-not": [expression(rng, 1, holes)]} if k % 5 == 0 else {}
        given.append(rules.Rule.load(rule))
    given += [rules.Rule.load({"id": "x", "type": "structure", "pattern": p}) for p in ("$X", "...", "[..., ..., a]", "f(..., $X, ..., $X, ...)", "f(...)", "[$X, ...]", "pass", "global a, b", "$X == $X")]
    given.append(rules.Rule(id="not alone", type="structure", patterns_not=("a",)))
    trees, hit = rules.Structures(given), set()
    for _ in range(60):
        code = "\n".join(statement(rng, 3) for _ in range(12)) + "\nf(1, a, b, a)\nglobal a, b\npass\n[b, [c, a]]\n"
        source = engine.parse("1", "a.py", code)
        got = trees.facts(source)
        assert got == one_at_a_time(given, source)
        hit |= got.keys()
    assert len(hit) > 200 and len(given) - 1 not in hit
    again = pickle.loads(pickle.dumps(trees))
    assert again.facts(source) == got


def test_common_beginnings_are_one_path():
    one, two = (PatternTree([rules.parsed(p) for p in x]) for x in (["f(a, 1)"], ["f(a, 1)", "f(a, 2)", "f(a, $X)", "f(a, 1)"]))
    assert len(one.steps) < len(two.steps) < 2 * len(one.steps)
    at = two.candidates(ast.parse("f(a, 1)\nf(a, 3)\n"))
    assert sorted(map(sorted, at.values())) == [[0, 2, 3], [2]]


def test_metavariables_are_compared_after_the_walk():
    source = engine.parse("1", "a.py", "a.b == a.b\na == b\n")
    assert [f.line_number for f in rules.Structures([rules.Rule(type="structure", pattern="$X == $X")]).facts(source)[0]] == [1]


def test_a_broken_rule_costs_no_other_one(spark):
    given = [rules.Rule(id=i, type="structure", pattern=p, patterns_any=q) for i, p, q in (("ok", "f($X)", ()), ("bad", "f($", ()), ("void", "", ("",)), ("late", "g()", ()))]
    rows = spark.createDataFrame([("1", "f(1)\ng()\n"), ("2", None), ("3", ""), ("4", "h()\n")], "file_id string, code string")
    found = engine.facts(rows, extra={"custom_rules": rules.detector(given, taint=False, smells=False)}).collect()
    assert [(f.file_id, f.kind, f.scope or f.name) for f in found] == [("1", "issue", "ok"), ("1", "failure", "bad"), ("1", "failure", "void"), ("1", "issue", "late"), ("4", "failure", "bad"), ("4", "failure", "void")]


def test_deep_code_and_long_lists():
    deep = engine.parse("1", "a.py", "x = " + " + ".join(["'a'"] * 5_000) + "\nf(" + "1, " * 5_000 + "2)\n")
    given = [rules.Rule(type="structure", pattern=p) for p in ("f(..., 2)", "f(..., 1, ..., 3)", "$X + 'a'")]
    assert {k: len(v) for k, v in rules.Structures(given).facts(deep).items()} == {0: 1, 2: 4_999}


def test_a_thousand_rules_cost_about_as_much_as_ten():
    rng = random.Random(12)
    source = engine.parse("1", "a.py", "\n".join(statement(rng, 3) for _ in range(1_500)))
    given = [rules.Rule(id=str(k), type="structure", pattern=f"name_{k}($X, ..., key_{k % 7}=1)") for k in range(1_000)]

    def took(n):
        trees = rules.Structures(given[:n])
        began = time.process_time()
        for _ in range(3):
            trees.facts(source)
        return time.process_time() - began

    took(10)
    assert took(1_000) < 3 * took(10)
