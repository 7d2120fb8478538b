"""Names of a file: its module, what it defines, what it imports under which name, and what it refers to. Operators join these
facts over files (operators/symbols.py)."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

from .source import FUNCTION, Fact, Source, calls_name, children, name_of

NAME = "symbols"
#: Directories that hold packages but are no part of their names
ROOTS = ("src", "lib")


def module_of(path: str, roots: tuple[str, ...] = ROOTS) -> str:
    """The dotted name under which a file is imported: its path below a root, a package's own file standing for the package."""
    parts = [p for p in path.removesuffix(".py").split("/") if p not in ("", ".")]
    if len(parts) > 1 and parts[0] in roots:
        parts = parts[1:]
    return ".".join(parts[:-1] if parts[-1:] == ["__init__"] and len(parts) > 1 else parts)


def written(node: ast.AST | None) -> str | None:
    """a.b.c of a name or a chain of attributes that starts at a name; null of anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def place(node: ast.AST) -> str:
    """Where an expression stands: no two expressions of a kind share it."""
    return f"{node.lineno}:{node.col_offset}:{node.end_lineno}:{node.end_col_offset}"


def scoped(tree: ast.AST) -> Iterator[tuple[ast.AST, str, str]]:
    """Every node with the dotted name of the function or class around it and that of the class whose body it is below."""
    stack = [(tree, "", "")]
    while stack:
        node, scope, owner = stack.pop()
        yield node, scope, owner
        if isinstance(node, (*FUNCTION, ast.ClassDef)):
            scope = f"{scope}.{node.name}" if scope else node.name
            owner = scope if isinstance(node, ast.ClassDef) else owner
        stack += [(c, scope, owner) for c in reversed(children(node))]


def absolute(module: str, is_package: bool, level: int, name: str | None) -> str:
    """What an import names, relative ones counted from the module."""
    if not level:
        return name or ""
    base = module.split(".") if is_package else module.split(".")[:-1]
    base = base[: len(base) - (level - 1)] if level > 1 else base
    return ".".join([*base, *([name] if name else [])])


def signature(f: ast.AST) -> str:
    """Positional parameters that must be given, all positional ones, 1 if more are taken, 1 if the body raises
    NotImplementedError, joined by commas."""
    a = f.args
    n = len(a.posonlyargs) + len(a.args)
    raises = any(isinstance(s, ast.Raise) and (calls_name(s.exc, "NotImplementedError") or name_of(s.exc) == "NotImplementedError") for s in f.body)
    return f"{n - len(a.defaults)},{n},{int(a.vararg is not None)},{int(raises)}"


def detect(source: Source) -> Iterator[Fact]:
    module, is_package = module_of(source.path), source.path.endswith("__init__.py")

    def fact(kind: str, name: str, node: ast.AST, scope: str, **more) -> Fact:
        return Fact(NAME, kind, name, line_number=getattr(node, "lineno", None), scope=scope, **more)

    yield Fact(NAME, "module", module)
    touched: dict[str, Counter] = {}
    for node, scope, owner in scoped(source.tree):
        own = ".".join(filter(None, (scope, getattr(node, "name", None))))
        if isinstance(node, ast.ClassDef):
            yield fact("definition", own, node, scope, title="class")
            for base in node.bases:
                if text := written(base.value if isinstance(base, ast.Subscript) else base):
                    yield fact("reference", text, base, own, title="base", detail=place(base))
        elif isinstance(node, FUNCTION):
            yield fact("definition", own, node, scope, title="method" if owner and scope == owner else "function", detail=signature(node))
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                if text := written(a.annotation):
                    yield fact("reference", text, a, own, title="annotation", detail=a.arg)
        elif isinstance(node, ast.Import):
            for a in node.names:
                # import a.b binds a alone
                yield fact("alias", a.asname or a.name.split(".")[0], node, scope, detail=a.name if a.asname else a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            target = absolute(module, is_package, node.level, node.module)
            for a in node.names:
                yield fact("alias", a.asname or a.name, node, scope, detail=target if a.name == "*" else f"{target}.{a.name}" if target else a.name)
        elif isinstance(node, ast.Call):
            if text := written(node.func):
                yield fact("reference", text, node, scope, title="call", detail=place(node))
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            touched.setdefault(scope, Counter())[node.value.id] += 1
    for scope, names in touched.items():
        for name, n in names.items():
            yield Fact(NAME, "touch", name, scope=scope, value=float(n))
