"""Quality of tests: what they assert, and their smells. Run on test files."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

from .source import FUNCTION, HERE, Fact, Source, children, measure, walk

NAME = "test_quality"
#: Fixed values. Assertions by what they say; all but the weak ones are strong
STRONG = frozenset("""assertEqual assertEquals assertNotEqual assertNotEquals assertIs assertIsNot assertIn assertNotIn
 assertGreater assertGreaterEqual assertLess assertLessEqual assertAlmostEqual assertNotAlmostEqual assertDictEqual assertListEqual
 assertSetEqual assertTupleEqual assertSequenceEqual assertCountEqual assertMultiLineEqual assertRegex assertNotRegex""".split())
WEAK = frozenset("assertTrue assertFalse assert_ ok".split())
EXCEPTION = frozenset("assertRaises assertRaisesRegex assertWarns assertWarnsRegex assertLogs assertNoLogs".split())
TYPE = frozenset("assertIsInstance assertNotIsInstance assertIsNone assertIsNotNone".split())
FILE_CALLS, NETWORK_CALLS = frozenset(("open", "read", "write")), frozenset(("get", "post", "put", "delete", "request"))
ROULETTE, LONG, EAGER, LAZY, FIXTURE, DUPLICATED = 3, 50, 3, 5, 30, 0.3


def _issue(rule: str, severity: str, title: str, line: int | None) -> Fact:
    return Fact(NAME, "issue", rule, severity, title, line)


def _asserts(node: ast.AST) -> str | None:
    """The class of an assertion, null of any other node."""
    if isinstance(node, ast.Assert):
        return "weak"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        a = node.func.attr
        return "weak" if a in WEAK else "exception" if a in EXCEPTION else "type" if a in TYPE else "strong" if a in STRONG else None
    return None


def _silent(node: ast.AST) -> bool:
    """Whether an assertion has no message."""
    return not node.msg if isinstance(node, ast.Assert) else len(node.args) < 3


def kinds(function: ast.AST) -> str:
    """The kinds of a function's nodes in breadth-first order, as one string."""
    return "".join(type(n).__name__ for n in walk(function))


def likeness(a: str, b: str) -> float:
    """Places with the same character, of those of the longer string."""
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def detect(source: Source) -> Iterator[Fact]:
    tests = [f for f in source.functions if f.name.startswith("test_")]
    for f in tests:
        nodes = walk(f)
        made = [(kind, n) for n in nodes if (kind := _asserts(n))]
        weak, silent = sum(kind == "weak" for kind, _ in made), sum(_silent(n) for _, n in made)
        yield measure(NAME, "assertions", len(made), f.name, f.lineno)
        yield measure(NAME, "weak_assertions", weak, f.name, f.lineno)
        if not made:
            yield _issue("TEST_ASSERT_001", "high", f"Test without assertions: {f.name}", f.lineno)
        if len(made) >= ROULETTE and silent >= ROULETTE:
            yield _issue("TEST_SMELL_001", "medium", f"Assertion Roulette: {f.name}", f.lineno)
        if f.end_lineno - f.lineno > LONG:
            yield _issue("TEST_SMELL_002", "medium", f"Long Test: {f.name}", f.lineno)
        attributes = [n.func.attr for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)]
        if len(set(attributes)) > EAGER:
            yield _issue("TEST_SMELL_003", "low", f"Eager Test: {f.name}", f.lineno)
        if sum(isinstance(n, ast.Assert) for n in nodes) + sum(a.startswith("assert") for a in attributes) > LAZY:
            yield _issue("TEST_SMELL_004", "low", f"Lazy Test: {f.name}", f.lineno)
        bare = {n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        if bare & FILE_CALLS or NETWORK_CALLS.intersection(attributes):
            yield _issue("TEST_SMELL_005", "medium", f"Mystery Guest: {f.name}", f.lineno)
    for f in source.plain_functions:
        if f.name in ("setUp", "setUpClass") and f.end_lineno - f.lineno > FIXTURE:
            yield _issue("TEST_SMELL_006", "low", f"General Fixture in {HERE}", f.lineno)
    shapes = [kinds(f) for f in tests if not isinstance(f, FUNCTION[1])]
    pairs = [likeness(a, b) for a, b in combinations(shapes, 2)]
    mean = sum(pairs) / len(pairs) if pairs else 0.0
    yield measure(NAME, "duplication", mean)
    if mean > DUPLICATED:
        yield _issue("TEST_SMELL_007", "medium", f"Test Code Duplication in {HERE}", None)


def edges_of(function: ast.AST) -> list[str]:
    """A tree's shape: every kind of node below every other kind, numbered where it stands there several times."""
    seen: Counter = Counter()
    out = []
    for node in walk(function):
        for child in children(node):
            edge = f"{type(node).__name__}>{type(child).__name__}"
            seen[edge] += 1
            out.append(f"{edge}#{seen[edge]}")
    return out


def shapes(source: Source) -> Iterator[Fact]:
    """The shape of every test, as a fact of kind "shape": its edges, joined by spaces."""
    for f in source.functions:
        if f.name.startswith("test_"):
            yield Fact(NAME, "shape", f.name, line_number=f.lineno, detail=" ".join(edges_of(f)))
