"""Style: names, docstrings, type hints, lines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import combinations

from .source import Fact, Source, apart, measure, percent

NAME = "style"
SNAKE, PASCAL = re.compile(r"[a-z_][a-z0-9_]*"), re.compile(r"[A-Z][a-zA-Z0-9]*")
CAMEL, SINGLE = re.compile(r"[a-z]+([A-Z][a-z0-9]*)+"), re.compile(r"[a-z]")
#: Fixed values
ALLOWED_SINGLE, SIMILAR_PAIRS = frozenset("ijkxyz"), 5
LONG, VERY_LONG, TRAILING, DOCUMENTED, HINTED = 88, 120, 5, 80, 50


def _issue(rule: str, severity: str, title: str, line: int) -> Fact:
    return Fact(NAME, "issue", rule, severity, title, line)


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or more than `most` if it is over that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, corner = i, row[0]
        row[0] = i
        for j, y in enumerate(b, 1):
            left = min(left + 1, row[j] + 1, corner + (x != y))
            corner, row[j] = row[j], left
    return row[-1]


def similar(names: set[str]) -> list[tuple[str, str]]:
    """The first pairs in alphabetical order whose distance is a third of the shorter name at most."""
    out = []
    for a, b in combinations(sorted(n for n in names if len(n) > 3), 2):
        most = min(len(a), len(b)) // 3
        if 0 < distance(a, b, most) <= most:
            out.append((a, b))
            if len(out) == SIMILAR_PAIRS:
                break
    return out


def naming(source: Source) -> Iterator[Fact]:
    names: set[str] = set()
    for node in source.nodes:
        if isinstance(node, ast.FunctionDef):
            names.add(node.name)
            if CAMEL.fullmatch(node.name) and not SNAKE.fullmatch(node.name):
                yield _issue("PEP8_NAMING_NAMING_CAMELCASE_FUNCTION", "low", f"Function '{node.name}' should use snake_case, not camelCase", node.lineno)
        elif isinstance(node, ast.ClassDef):
            names.add(node.name)
            if not PASCAL.fullmatch(node.name):
                yield _issue("PEP8_NAMING_NAMING_CLASS", "low", f"Class '{node.name}' should use PascalCase", node.lineno)
        elif isinstance(node, ast.Assign):
            for target in (t.id for t in node.targets if isinstance(t, ast.Name)):
                names.add(target)
                if SINGLE.fullmatch(target) and target not in ALLOWED_SINGLE:
                    yield _issue("PEP8_NAMING_NAMING_SINGLE_CHAR", "info", f"Avoid single-letter variable '{target}' - use descriptive names", node.lineno)
    for a, b in similar(names):
        yield _issue("PEP8_NAMING_NAMING_SIMILAR", "info", f"Similar names '{a}' and '{b}' may cause confusion", 0)


def docstrings(source: Source) -> Iterator[Fact]:
    functions, classes = source.plain_functions, source.classes
    with_f, with_c = (sum(bool(ast.get_docstring(n)) for n in x) for x in (functions, classes))
    coverage = percent(with_f + with_c, len(functions) + len(classes))
    for name, value in (("functions", len(functions)), ("functions_documented", with_f), ("classes", len(classes)), ("classes_documented", with_c), ("module_documented", bool(ast.get_docstring(source.tree))), ("docstring_coverage", coverage)):
        yield measure(NAME, name, value)
    if coverage < DOCUMENTED:
        yield _issue("PEP257_COVERAGE", "low", f"Low docstring coverage: {coverage:.1f}%", 1)


def type_hints(source: Source) -> Iterator[Fact]:
    functions = source.plain_functions
    arguments = [a for f in functions for a in f.args.args]
    hinted = sum(f.returns is not None or any(a.annotation is not None for a in f.args.args) for f in functions)
    coverage = percent(hinted, len(functions))
    yield measure(NAME, "functions_hinted", hinted)
    yield measure(NAME, "arguments", len(arguments))
    yield measure(NAME, "arguments_hinted", sum(a.annotation is not None for a in arguments))
    yield measure(NAME, "returns_hinted", sum(f.returns is not None for f in functions))
    if coverage < HINTED:
        yield _issue("TYPEHINT_COVERAGE", "info", f"Low type hint coverage: {coverage:.1f}%", 1)


def consistency(source: Source) -> Iterator[Fact]:
    lines, code = source.lines, source.code
    widths = {(len(line) - len(line.lstrip())) % 4 if line[0] == " " else len(line) - len(line.lstrip()) for line in lines if line[:1] in (" ", "\t")}
    very, trailing = sum(len(x) > VERY_LONG for x in lines), sum(x.endswith((" ", "\t")) for x in lines)
    found = {
        "lines": len(lines),
        "long_lines": sum(len(x) > LONG for x in lines),
        "very_long_lines": very,
        "trailing_whitespace": trailing,
        "indentation_styles": len(widths),
        "single_quotes": code.count("'") - code.count("\\'"),
        "double_quotes": code.count('"') - code.count('\\"'),
    }
    for name, value in found.items():
        yield measure(NAME, name, value)
    if very:
        yield _issue("PEP8_LINE_LENGTH", "low", f"{very} lines exceed 120 characters", 1)
    if trailing > TRAILING:
        yield _issue("PEP8_TRAILING_WHITESPACE", "info", f"{trailing} lines with trailing whitespace", 1)


detect = apart(NAME, naming, docstrings, type_hints, consistency)
