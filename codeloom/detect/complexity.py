"""Complexity of blocks, functions and files."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

from .source import BLOCK, FUNCTION, HERE, NESTED, Fact, Source, apart, children, identity, inside, measure, walk

NAME = "complexity"
#: Rule, measure, bound, severity, second bound, severity beyond it, title. A file's title takes its name.
BOUNDS = (
    ("COMPLEXITY001", "cyclomatic", 10, "medium", 20, "high", "High cyclomatic complexity in '{}'"),
    ("COMPLEXITY002", "halstead_difficulty", 20, "medium", None, None, "High Halstead difficulty in {}"),
    ("COMPLEXITY003", "cognitive", 15, "medium", 30, "high", "High cognitive complexity in '{}'"),
    ("COMPLEXITY004", "halstead_volume", 8000, "medium", None, None, "Excessive Halstead volume in {}"),
    ("COMPLEXITY005", "nesting", 4, "medium", 6, "high", "Excessive nesting depth in {}"),
    ("COMPLEXITY006", "essential", 4, "medium", None, None, "High essential complexity in '{}'"),
    ("COMPLEXITY007", "halstead_bugs", 2, "high", None, None, "High predicted bug count in {}"),
    ("COMPLEXITY008", "halstead_effort", 100_000, "low", None, None, "High implementation effort in {}"),
    ("COMPLEXITY009", "npath", 200, "high", None, None, "Excessive execution paths in '{}'"),
)


def decisions(node: ast.AST) -> int:
    """What a node adds to McCabe's number: a branch, a loop and its else, a handler and a try's else, each further operand of
    `and`/`or`, each generator of a comprehension and its filters, an assertion, a case."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.Try():
            return len(node.handlers) + bool(node.orelse)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.Match():
            return len(node.cases)
    return 0


def _own(root: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a block that no inner function or class holds."""
    stack = list(children(root))
    while stack:
        node = stack.pop()
        if not isinstance(node, (*FUNCTION, ast.ClassDef)):
            yield node
            stack.extend(children(node))


def cyclomatic(root: ast.AST) -> int:
    """Of a function: its own decisions and 1. Of a class: the mean of its methods' numbers and, with two or more, 1; of one
    without methods, its body's decisions and 1."""
    own = 1 + sum(map(decisions, _own(root)))
    if not isinstance(root, ast.ClassDef):
        return own
    methods = [cyclomatic(m) for m in root.body if isinstance(m, FUNCTION)]
    return (own + sum(methods)) // len(methods) + (len(methods) > 1) if methods else own


def simple(root: ast.AST) -> int:
    """1 and the branches, loops, handlers and further operands of a whole subtree."""
    return 1 + sum(isinstance(n, NESTED) or (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in walk(root))


def cognitive(function: ast.AST) -> int:
    total = 0
    for node, depth, owner in inside(function, NESTED):
        if isinstance(node, (*NESTED, ast.IfExp)):
            total += 1 + depth
        elif isinstance(node, (ast.With, ast.Lambda, ast.Break, ast.Continue)):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        elif isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp)):
            total += len(node.generators)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            total += node.func.id == owner
    return total


def nesting(root: ast.AST) -> int:
    return max((depth + isinstance(node, BLOCK) for node, depth, _ in inside(root, BLOCK)), default=0)


def npath(body: list[ast.AST]) -> int:
    """Paths through statements one after the other, from 1 on: a statement with branches adds their paths, `and`/`or` outside
    a branch's header multiplies what has come together so far by its operands."""
    blocks: list[list] = [[1, list(reversed(body)), None]]  # paths so far, what is still to come, the block around it
    while True:
        block = blocks[-1]
        paths, queue, around = block
        if not queue:
            blocks.pop()
            if around is None:
                return paths
            around[0] += paths
            continue
        node = queue.pop()
        inner: list[list[ast.AST]] = []
        if isinstance(node, ast.If):
            inner = [node.body, node.orelse]
        elif isinstance(node, (ast.For, ast.While)):
            inner = [node.body]
        elif isinstance(node, ast.Try):
            inner = [node.body, *(h.body for h in node.handlers), node.finalbody]
        elif isinstance(node, ast.BoolOp):
            block[0] *= len(node.values)
        else:
            queue.extend(reversed(children(node)))
        blocks += [[1, list(reversed(x)), block] for x in inner]


def essential(block: int, structured: int) -> int:
    """An approximation: the block's number less all structured statements of the file, 1 at least."""
    return max(1, block - structured + 1)


def halstead_counts(tree: ast.AST) -> tuple[int, int, int, int]:
    """Distinct operators, distinct operands, operators, operands of arithmetic, logic, comparisons and augmented assignments.
    An operand is a name, an attribute's last part, a literal's value or an expression's text, told apart by function."""
    operators: list[str] = []
    operands: list[tuple] = []
    known: dict = {}

    def take(ops: list, values: list, owner: str | None) -> None:
        operators.extend(type(op).__name__ for op in ops)
        for v in values:
            key = v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else (type(v.value).__name__, v.value) if isinstance(v, ast.Constant) else (ast.AST, identity(v, known))
            operands.append((owner, key))

    for node, _, owner in inside(tree, ()):
        match node:
            case ast.BinOp():
                take([node.op], [node.left, node.right], owner)
            case ast.UnaryOp():
                take([node.op], [node.operand], owner)
            case ast.BoolOp():
                take([node.op], node.values, owner)
            case ast.AugAssign():
                take([node.op], [node.target, node.value], owner)
            case ast.Compare():
                take(node.ops, [node.left, *node.comparators], owner)
    return len(set(operators)), len(set(operands)), len(operators), len(operands)


def halstead(h1: int, h2: int, n1: int, n2: int) -> dict[str, float]:
    volume = (n1 + n2) * math.log2(h1 + h2) if h1 + h2 else 0.0
    difficulty = h1 / 2 * n2 / h2 if h2 else 0.0
    return {"volume": volume, "difficulty": difficulty, "effort": volume * difficulty, "time": volume * difficulty / 18, "bugs": volume / 3000}


def blocks(source: Source) -> Iterator[Fact]:
    structured = len(source.of(*BLOCK))
    for block in source.of(*FUNCTION, ast.ClassDef):
        cc = cyclomatic(block)
        yield measure(NAME, "cyclomatic", cc, block.name, block.lineno)
        yield measure(NAME, "essential", essential(cc, structured), block.name, block.lineno)


def functions(source: Source) -> Iterator[Fact]:
    for f in source.functions:
        yield measure(NAME, "cognitive", cognitive(f), f.name, f.lineno)
        yield measure(NAME, "npath", npath(f.body), f.name, f.lineno)


def whole(source: Source) -> Iterator[Fact]:
    yield measure(NAME, "nesting", nesting(source.tree))


def counts(source: Source) -> Iterator[Fact]:
    for name, value in halstead(*halstead_counts(source.tree)).items():
        yield measure(NAME, f"halstead_{name}", value)


measures = apart(NAME, blocks, functions, whole, counts)


def detect(source: Source) -> Iterator[Fact]:
    """Every measure, and an issue for each one beyond its bound."""
    bounds = {b[1]: b for b in BOUNDS}
    for fact in measures(source):
        yield fact
        if fact.kind == "measure" and fact.name in bounds and fact.value > bounds[fact.name][2]:
            rule, _, _, severity, second, worse, title = bounds[fact.name]
            severity = worse if second is not None and fact.value > second else severity
            yield Fact(NAME, "issue", rule, severity, title.format(fact.scope or HERE), fact.line_number)
