"""A parsed file and the walks that detectors share."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Statements that open a nested block, and those that cost more the deeper they stand
BLOCK = (ast.If, ast.For, ast.While, ast.With, ast.Try)
NESTED = (ast.If, ast.While, ast.For, ast.ExceptHandler)

#: Stand for the file's name in a title, and for its stem as a scope: what a detector says of equal codes is equal. No code that
#: parses holds them
HERE, STEM = "\0file\0", "\0stem\0"


def stem_of(file_name: str) -> str:
    return file_name.rpartition(".")[0] or file_name


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below, in the order of the fields. A node keeps them: every detector walks the same tree."""
    try:
        return node.below
    except AttributeError:
        out: list[ast.AST] = []
        for name in node._fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                out += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                out.append(value)
        node.below = out
        return out


def walk(root: ast.AST) -> list[ast.AST]:
    """A node and all below it, breadth first."""
    out = [root]
    for node in out:
        out += children(node)
    return out


@dataclass(frozen=True)
class Fact:
    """kind "issue": name is the rule, value unused. kind "measure": name and value, scope is what was measured (null: the
    file). kind "edge": scope imports name. kind "identifier": scope is its role, name the identifier."""

    analyzer: str
    kind: str
    name: str
    severity: str | None = None
    title: str | None = None
    line_number: int | None = None
    scope: str | None = None
    value: float | None = None
    detail: str | None = None


def measure(analyzer: str, name: str, value: float, scope: str | None = None, line: int | None = None) -> Fact:
    return Fact(analyzer, "measure", name, line_number=line, scope=scope, value=float(value))


@dataclass
class Source:
    file_id: str
    path: str
    code: str
    tree: ast.Module = field(repr=False)

    @property
    def file_name(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def stem(self) -> str:
        return stem_of(self.file_name)

    @cached_property
    def lines(self) -> list[str]:
        return self.code.split("\n")

    @cached_property
    def nodes(self) -> list[ast.AST]:
        """Breadth first, children in the order of their fields."""
        return walk(self.tree)

    @cached_property
    def functions(self) -> list:
        return [n for n in self.nodes if isinstance(n, FUNCTION)]

    @cached_property
    def plain_functions(self) -> list[ast.FunctionDef]:
        """Without the async ones, which most coverage figures leave out."""
        return [n for n in self.functions if isinstance(n, ast.FunctionDef)]

    @cached_property
    def classes(self) -> list[ast.ClassDef]:
        return [n for n in self.nodes if isinstance(n, ast.ClassDef)]

    def of(self, *kinds: type) -> list:
        return [n for n in self.nodes if isinstance(n, kinds)]


def inside(root: ast.AST, kinds: tuple[type, ...]) -> Iterator[tuple[ast.AST, int, str | None]]:
    """Every node of a subtree, the number of its ancestors below `root` (itself included) that are of `kinds`, and the name of
    the innermost function around it. Iterative, so deep trees do not overflow the stack."""
    stack: list[tuple[ast.AST, int, str | None]] = [(root, 0, root.name if isinstance(root, FUNCTION) else None)]
    while stack:
        node, depth, owner = stack.pop()
        yield node, depth, owner
        depth += isinstance(node, kinds)
        for child in children(node):
            stack.append((child, depth, child.name if isinstance(child, FUNCTION) else owner))


def failure(analyzer: str, error: BaseException, part: str | None = None) -> Fact:
    return Fact(analyzer, "failure", type(error).__name__, title=str(error)[:200], scope=part)


def apart(analyzer: str, *parts: Callable[[Source], Iterator[Fact]]) -> Callable[[Source], Iterator[Fact]]:
    """A detector of several parts. One that fails is a fact of kind "failure" with the part's name as scope; what it has found
    before and what the others find stays."""

    def detect(source: Source) -> Iterator[Fact]:
        for part in parts:
            try:
                yield from part(source)
            except Exception as e:  # as data: one part must not cost the others
                yield failure(analyzer, e, part.__name__)

    return detect


def identity(node: ast.AST, known: dict[ast.AST | tuple, int]) -> int:
    """A number that two expressions share if and only if they are written alike. `known` has those of a file; no recursion,
    and no node is looked at twice."""
    stack = [node]
    while stack:
        at = stack[-1]
        waiting = [] if at in known else [c for c in children(at) if c not in known]
        if waiting:
            stack += waiting
            continue
        stack.pop()
        if at not in known:
            parts: list = [type(at)]
            for name in at._fields:
                value = getattr(at, name, None)
                for x in value if isinstance(value, list) else (value,):
                    parts.append((name, known[x]) if isinstance(x, ast.AST) else (name, type(x), x))
            known[at] = known.setdefault(tuple(parts), len(known))
    return known[node]


def attribute_tail(node: ast.Attribute, most: int = 3) -> str:
    """The last parts of a chain of attributes, with the name it starts from if it is that short."""
    parts: list[str] = []
    at: ast.AST = node
    while isinstance(at, ast.Attribute) and len(parts) < most:
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        parts.append(at.id)
    return ".".join(reversed(parts))


def dotted(call: ast.Call) -> str:
    """a.b.c of a call a.b.c(...); of x().b.c(...) only b.c; empty if what is called has no name."""
    parts, at = [], call.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        parts.append(at.id)
    elif not parts:
        return ""
    return ".".join(reversed(parts))


def called(call: ast.Call) -> str:
    """The last part of a call's name."""
    f = call.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def name_of(node: ast.AST | None) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def calls_name(node: ast.AST | None, name: str) -> bool:
    """Whether the node is a call of the bare name."""
    return isinstance(node, ast.Call) and name_of(node.func) == name


def number(node: ast.AST | None) -> int | float | complex | None:
    """The value of a numeric literal; booleans are none."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, complex)) and not isinstance(node.value, bool):
        return node.value
    return None


def is_test(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.startswith("test_") or name.endswith("_test.py") or "tests/" in path or "/test/" in path


def opens_with_constant(node: ast.AST) -> bool:
    first = node.body[0] if node.body else None
    return isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)


def argument_names(f: ast.AST) -> list[str]:
    """Positional ones, keyword-only ones, *args, **kwargs."""
    a = f.args
    return [x.arg for x in (*a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]


def percent(part: int, whole: int, empty: float = 100.0) -> float:
    return 100.0 * part / whole if whole else empty
