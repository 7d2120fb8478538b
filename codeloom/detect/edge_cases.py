"""Edge cases: boundaries, partitions, off-by-one errors, missing checks, overflow."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import islice

from .source import Fact, Source, apart, calls_name, measure, name_of, number, walk

NAME = "edge_cases"
#: Fixed values
MISSING_ELSE, NONE_CHECKS, DIVISIONS, OVERFLOWS, EMPTY_COLLECTIONS, LARGE = 3, 3, 5, 3, 10, 1_000_000
#: Fixed values. Texts in a function that count as a check of types or of None
TYPE_CHECK = (re.compile(r"isinstance\s*\("), re.compile(r"type\s*\(.*\)\s*=="))
NONE_CHECK = (re.compile(r"is\s+not\s+None|!=\s*None"),)


def _issue(rule: str, severity: str, title: str, line: int | None) -> Fact:
    return Fact(NAME, "issue", rule, severity, title, line)


def _zero(node: ast.AST) -> bool:
    return number(node) == 0 and number(node) is not None


def comparisons(source: Source) -> Iterator[Fact]:
    """Comparisons with one operator. `x > 0` is two findings: at the boundary, and without zero."""
    for node in source.of(ast.Compare):
        if len(node.ops) != 1:
            continue
        op, right = node.ops[0], node.comparators[0]
        found = []
        if isinstance(op, ast.Lt) and calls_name(right, "len"):
            found.append("potential_off_by_one")
        if isinstance(op, (ast.Gt, ast.GtE)) and _zero(right):
            found += ["boundary_at_zero", "missing_zero_check"][: 1 + isinstance(op, ast.Gt)]
        for kind in found:
            yield _issue("EDGE_BVA001", "medium", f"Boundary Issue: {kind}", node.lineno)


def partitions(source: Source) -> Iterator[Fact]:
    ifs = source.of(ast.If)
    without = sum(not n.orelse for n in ifs)
    yield measure(NAME, "conditionals", len(ifs))
    yield measure(NAME, "missing_else", without)
    yield measure(NAME, "complex_conditions", sum(isinstance(n.test, ast.BoolOp) and len(n.test.values) > 2 for n in ifs))
    if without > MISSING_ELSE:
        yield _issue("EDGE_EP001", "low", "Incomplete Partition Coverage", None)
    for n in ifs:
        t = n.test
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Gt) and _zero(t.comparators[0]):
            yield _issue("EDGE_EP002", "medium", "Missing Partition: missing_zero_partition", n.lineno)


def off_by_one(source: Source) -> Iterator[Fact]:
    """Loops over range(len(x)), once for each subscript with arithmetic in them; slices from 1 to len()."""
    for loop in source.of(ast.For):
        if calls_name(loop.iter, "range") and len(loop.iter.args) == 1 and calls_name(loop.iter.args[0], "len"):
            for n in walk(loop):
                if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.BinOp):
                    yield _issue("EDGE_OBOE001", "high", "Potential Off-by-One Error: potential_oboe_in_loop", loop.lineno)
    for n in source.of(ast.Subscript):
        if isinstance(n.slice, ast.Slice) and number(n.slice.lower) == 1 and calls_name(n.slice.upper, "len"):
            yield _issue("EDGE_OBOE001", "high", "Potential Off-by-One Error: slice_oboe", n.lineno)


def validation(source: Source) -> Iterator[Fact]:
    """Of functions with positional parameters: neither a check of types nor of None in their text; parameters that `is` never
    compares, the first NONE_CHECKS in order; no comparison or branch at all."""
    for f in source.functions:
        names = [a.arg for a in f.args.args]
        if not names:
            continue
        text = "\n".join(source.lines[f.lineno - 1 : f.end_lineno])
        if not any(p.search(text) for p in (*TYPE_CHECK, *NONE_CHECK)):
            yield _issue("EDGE_VAL001", "medium", f"Incomplete Input Validation in '{f.name}'", f.lineno)
        inner = walk(f)
        checked = {name_of(n.left) for n in inner if isinstance(n, ast.Compare) and any(isinstance(op, (ast.Is, ast.IsNot)) for op in n.ops)}
        for name in islice((n for n in names if n not in checked), NONE_CHECKS):
            yield _issue("EDGE_NULL001", "medium", f"Missing None Check: {name}", f.lineno)
        if not any(isinstance(n, (ast.Compare, ast.If)) for n in inner):
            yield _issue("EDGE_BVA002", "medium", f"Missing Bounds Check: {f.name}", f.lineno)


def arithmetic(source: Source) -> Iterator[Fact]:
    sums = source.of(ast.BinOp)
    for n in islice((n for n in sums if isinstance(n.op, (ast.Div, ast.FloorDiv, ast.Mod)) and isinstance(n.right, ast.Name)), DIVISIONS):
        yield _issue("EDGE_OVF001", "high", f"Division by Zero Risk: {n.right.id}", n.lineno)
    large = (n for n in sums if isinstance(n.op, (ast.Mult, ast.Pow)) and number(n.left) is not None and abs(number(n.left)) > LARGE)
    for n in islice(large, OVERFLOWS):
        yield _issue("EDGE_OVF002", "low", "Potential Numeric Overflow", n.lineno)


def empty_collections(source: Source) -> Iterator[Fact]:
    """The first subscripts of bare names. Not part of detect(): every one is found, checked or not."""
    for n in islice((n for n in source.of(ast.Subscript) if isinstance(n.value, ast.Name)), EMPTY_COLLECTIONS):
        yield _issue("EDGE_EMPTY001", "low", "Collection access without length check", n.lineno)


def counted(source: Source) -> Iterator[Fact]:
    yield measure(NAME, "functions", len(source.functions))


detect = apart(NAME, counted, comparisons, partitions, off_by_one, validation, arithmetic)
