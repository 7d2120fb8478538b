"""Architecture: coupling and cohesion of modules and classes, design principles, smells, imports."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

from .complexity import simple
from .source import FUNCTION, STEM, Fact, Source, apart, called, calls_name, measure, name_of, walk

NAME = "architecture"
#: Fixed values
MOST_METHODS, MOST_DUTIES, ELIF_CHAIN, MOST_ABSTRACT, ENVY = 10, 3, 4, 8, 3
GOD_WMC, GOD_LCOM, GOD_RFC = 47, 0.8, 50
#: Fixed values. What a method's name begins with, by the duty that it tells of
DUTIES = {
    "data": ("get_", "set_", "load_", "save_", "read_", "write_"),
    "validation": ("validate_", "check_", "verify_", "ensure_"),
    "transformation": ("transform_", "convert_", "process_", "calculate_"),
    "communication": ("send_", "receive_", "request_", "response_"),
    "rendering": ("render_", "display_", "show_", "draw_"),
}
#: Fixed values. What names of concrete classes end with
CONCRETE = ("Client", "Handler", "Repository", "Service", "Manager")
SEVERE = ("SRP", "DIP")


def imports(tree_nodes: list[ast.AST]) -> list[str]:
    """First parts of imported modules; relative imports without a module name have none."""
    out = []
    for node in tree_nodes:
        if isinstance(node, ast.Import):
            out += [a.name.split(".")[0] for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(node.module.split(".")[0])
    return out


def methods(cls: ast.ClassDef) -> list:
    return [m for m in cls.body if isinstance(m, FUNCTION)]


def self_attributes(root: ast.AST) -> set[str]:
    return {n.attr for n in walk(root) if isinstance(n, ast.Attribute) and name_of(n.value) == "self"}


def cohesion_groups(cls: ast.ClassDef) -> int:
    """Groups of methods that share attributes of self, directly or over others (LCOM4). Methods that use none are in no group;
    methods of one name are one. 0 with fewer than two methods that are not async."""
    plain = [m for m in cls.body if isinstance(m, ast.FunctionDef)]
    used: dict[str, set[str]] = {}
    if len(plain) > 1:
        for m in plain:
            if attributes := self_attributes(m):
                used.setdefault(m.name, set()).update(attributes)
    groups: list[set[str]] = []
    for attributes in used.values():
        apart = [g for g in groups if not g & attributes]
        groups = [*apart, attributes.union(*(g for g in groups if g & attributes))]
    return len(groups)


def weight(cls: ast.ClassDef) -> int:
    return sum(simple(m) for m in methods(cls))


def responses(root: ast.AST) -> int:
    """Distinct names of functions defined and called."""
    nodes = walk(root)
    return len({n.name for n in nodes if isinstance(n, FUNCTION)} | {called(n) for n in nodes if isinstance(n, ast.Call) and called(n)})


def _violation(principle: str, reason: str, line: int) -> Fact:
    return Fact(NAME, "issue", f"SOLID-{principle}", "high" if principle in SEVERE else "medium", f"{principle} violation", line, detail=reason)


def single_responsibility(source: Source) -> Iterator[Fact]:
    for cls in source.classes:
        names = [m.name.lower() for m in methods(cls)]
        if len(names) > MOST_METHODS:
            yield _violation("SRP", f"{cls.name}: {len(names)} methods", cls.lineno)
        duties = sorted(duty for duty, prefixes in DUTIES.items() if any(n.startswith(prefixes) for n in names))
        if len(duties) > MOST_DUTIES:
            yield _violation("SRP", f"{cls.name}: {', '.join(duties)}", cls.lineno)


def _chain(node: ast.If) -> int:
    """Ifs that follow one another, each the first statement of the last one's else."""
    length = 0
    while node.orelse and isinstance(node.orelse[0], ast.If):
        node, length = node.orelse[0], length + 1
    return length


def open_closed(source: Source) -> Iterator[Fact]:
    for node in source.of(ast.If, ast.Call):
        if isinstance(node, ast.If):
            if (n := _chain(node)) >= ELIF_CHAIN:
                yield _violation("OCP", f"{n + 1} branches", node.lineno)
        elif calls_name(node, "isinstance"):
            yield _violation("OCP", "isinstance", node.lineno)


def substitution(source: Source) -> Iterator[Fact]:
    """Raised NotImplementedError() calls in methods; of classes with one name, the last counts."""
    for cls in {c.name: c for c in source.classes}.values():
        for m in methods(cls):
            for n in walk(m):
                if isinstance(n, ast.Raise) and calls_name(n.exc, "NotImplementedError"):
                    yield _violation("LSP", f"{cls.name}.{m.name}", n.lineno)


def _abstract_marks(m: ast.AST) -> int:
    return sum(name_of(d) == "abstractmethod" for d in m.decorator_list)


def segregation(source: Source) -> Iterator[Fact]:
    for cls in source.classes:
        if (n := sum(map(_abstract_marks, methods(cls)))) > MOST_ABSTRACT:
            yield _violation("ISP", f"{cls.name}: {n} abstract methods", cls.lineno)


def inversion(source: Source) -> Iterator[Fact]:
    for node in source.of(ast.Assign):
        made = name_of(node.value.func) if isinstance(node.value, ast.Call) else None
        if made and made.endswith(CONCRETE):
            yield _violation("DIP", made, node.lineno)


def _smell(name: str, line: int, detail: str) -> Fact:
    return Fact(NAME, "issue", f"SMELL-{name.replace(' ', '_').upper()}", "high", f"{name} detected", line, detail=detail)


def god_classes(source: Source) -> Iterator[Fact]:
    """A class is judged with the classes inside it: their weights add up, their cohesion is averaged."""
    for cls in source.classes:
        family = [c for c in walk(cls) if isinstance(c, ast.ClassDef)]
        found = (("WMC", sum(map(weight, family)), GOD_WMC), ("LCOM", sum(map(cohesion_groups, family)) / len(family), GOD_LCOM), ("RFC", responses(cls), GOD_RFC))
        if reasons := [f"{k}={v:g}" for k, v, most in found if v > most]:
            yield _smell("God Class", cls.lineno, ", ".join(reasons))


def feature_envy(source: Source) -> Iterator[Fact]:
    """The first other object that a method touches more often than self and more than ENVY times."""
    for cls in source.classes:
        for m in methods(cls):
            touched = Counter(name_of(n.value) for n in walk(m) if isinstance(n, ast.Attribute) and name_of(n.value))
            own = touched.pop("self", 0)
            for other, n in touched.items():
                if n > max(own, ENVY):
                    yield _smell("Feature Envy", m.lineno, f"{cls.name}.{m.name}: {other} {n}, self {own}")
                    break


def modules(source: Source) -> Iterator[Fact]:
    roots = imports(source.nodes)
    for target in sorted(set(roots)):
        yield Fact(NAME, "edge", target, scope=STEM)
    classes = source.classes
    yield measure(NAME, "lcom", sum(map(cohesion_groups, classes)) / len(classes) if classes else 0.0)
    yield measure(NAME, "cbo", len({*roots, *(b.id for c in classes for b in c.bases if isinstance(b, ast.Name))}))
    yield measure(NAME, "rfc", responses(source.tree))
    yield measure(NAME, "wmc", sum(map(weight, classes)))
    yield measure(NAME, "classes", len(classes))
    yield measure(NAME, "all_functions", len(source.functions))
    yield measure(NAME, "all_classes", len(classes))
    yield measure(NAME, "all_methods", sum(len(methods(c)) for c in classes))
    yield measure(NAME, "abstract_methods", sum(bool(_abstract_marks(m)) for c in classes for m in methods(c)))


detect = apart(NAME, modules, single_responsibility, open_closed, substitution, segregation, inversion, god_classes, feature_envy)
