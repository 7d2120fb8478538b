"""Rules that users write: text, calls and literals, smells, taint, and structure with metavariables."""

from __future__ import annotations

import ast
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import count
from pathlib import Path
from typing import Any

from .architecture import imports
from .pattern_tree import META, UNCOMPARED, PatternTree, dots
from .source import Fact, Source, argument_names, called, failure, identity, name_of, number

NAME = "custom_rules"
#: Fixed values
ORDINARY, PARAMETERS, LINES, GOD_PARAMETERS, SIMILAR = (0, 1, -1, 2, 10, 100, 1000), 5, 50, 10, 2
#: Fixed values. Where untrusted data comes in and where it must not go, compared with the last part of a call's name
SOURCES = frozenset("input raw_input sys.argv request.args request.form request.json request.data request.files os.environ flask.request django.request read readline readlines".split())
SINKS = frozenset("eval exec compile __import__ open os.system subprocess.call subprocess.run subprocess.Popen execute executemany raw cursor.execute".split())
WORST_SINKS = frozenset(("eval", "exec", "os.system"))


@dataclass(frozen=True)
class Rule:
    """type: "regex" searches lines, "ast" compares names and literals with the pattern's text, "structure" matches the pattern
    as Python with $METAVARIABLES and `...`, "smell" and "taint" run the built-in ones."""

    id: str = "CUSTOM001"
    name: str = "Custom Rule"
    description: str = ""
    severity: str = "low"
    category: str = "custom"
    enabled: bool = True
    type: str = "ast"
    pattern: str = ""
    patterns_all: tuple[str, ...] = ()
    patterns_any: tuple[str, ...] = ()
    patterns_not: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    message: str = ""
    fix: str = ""
    suggestion: str = "Fix this issue"
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()

    @classmethod
    def load(cls, data: dict[str, Any]) -> Rule:
        """From a mapping with the keys of a rule file. A list under `patterns` stands for patterns-any; unknown severities are
        medium, other unknown keys have no effect."""
        keys = {k.replace("-", "_"): tuple(v) if isinstance(v, list) else v for k, v in data.items()}
        if "patterns" in keys:
            keys.setdefault("patterns_any", keys["patterns"])
        severity = str(keys.get("severity", "low")).lower()
        known = {k: v for k, v in keys.items() if k in cls.__dataclass_fields__}
        return replace(cls(**known), severity=severity if severity in ("critical", "high", "medium", "low", "info") else "medium")


def load_rules(path: str) -> list[Rule]:
    """The enabled rules of a YAML file; none if there is no such file."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    except FileNotFoundError:
        return []
    return [r for r in map(Rule.load, found.get("rules") or []) if r.enabled]


def default_rules() -> list[Rule]:
    """The rules that come with the library."""
    return load_rules(str(Path(__file__).with_name("default_rules.yaml")))


def loose(pattern: str) -> Callable[[ast.AST], bool]:
    """Whether a node's name or text agrees with a pattern's text in lower case: a called name or method that the pattern's text
    holds (before the parenthesis exactly, if the pattern has a $); an assignment of such a call; a literal that holds the
    pattern. An assigned method call has no name here, and every pattern without $ holds that."""
    low = pattern.lower()
    exact = low.split("(")[0].strip().replace("$func", "").strip() if "$" in low else None

    def names(call: ast.Call) -> bool:
        name = (name_of(call.func) or "").lower()
        return bool(exact) and name == exact if exact is not None else name in low

    def test(node: ast.AST) -> bool:
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute):
                return node.func.attr.lower() in low
            return isinstance(node.func, ast.Name) and names(node)
        if isinstance(node, ast.Assign):
            return isinstance(node.value, ast.Call) and names(node.value)
        return isinstance(node, ast.Constant) and isinstance(node.value, str) and low in node.value.lower()

    return test


def parsed(pattern: str) -> ast.AST:
    """A pattern's expression or statement, with metavariables as names."""
    tree = ast.parse(re.sub(r"\$([A-Z][A-Z0-9_]*)", META + r"\1", pattern)).body
    return tree[0].value if len(tree) == 1 and isinstance(tree[0], ast.Expr) else tree[0]


def structural(pattern: str) -> Callable[[ast.AST], dict[str, ast.AST] | None]:
    """What the metavariables of a pattern stand for in a node, or null if it does not match. A metavariable is one expression,
    the same one wherever it stands; `...` is any number of arguments or elements, or any expression."""
    want = parsed(pattern)
    known: dict = {}  # of the node at hand

    def one(p: Any, n: Any, bound: dict[str, ast.AST]) -> dict[str, ast.AST] | None:
        if isinstance(p, ast.Name) and p.id.startswith(META) and isinstance(n, ast.expr):
            key = p.id.removeprefix(META)
            if key in bound:
                return bound if identity(bound[key], known) == identity(n, known) else None
            return bound | {key: n}
        if dots(p) and isinstance(n, ast.expr):
            return bound
        if isinstance(p, list):
            return many(p, n, bound) if isinstance(n, list) else None
        if not isinstance(p, ast.AST):
            return bound if p == n and type(p) is type(n) else None
        if type(p) is not type(n):
            return None
        for name in p._fields:
            if name in UNCOMPARED:
                continue
            if (bound := one(getattr(p, name, None), getattr(n, name, None), bound)) is None:
                return None
        return bound

    def many(p: list, n: list, bound: dict[str, ast.AST]) -> dict[str, ast.AST] | None:
        if not p:
            return bound if not n else None
        if dots(p[0]) or (isinstance(p[0], ast.Expr) and dots(p[0].value)):
            return next((b for k in range(len(n) + 1) if (b := many(p[1:], n[k:], bound)) is not None), None)
        if not n or (b := one(p[0], n[0], bound)) is None:
            return None
        return many(p[1:], n[1:], b)

    def test(node: ast.AST) -> dict[str, ast.AST] | None:
        known.clear()
        return one(want, node, {})

    return test


def written(node: ast.AST, code: str) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return ast.get_source_segment(code, node) or ""


def _tests(rule: Rule) -> Callable[[ast.AST], dict[str, ast.AST] | None]:
    """The rule's algebra: none of patterns_not, and patterns_any, else all of patterns_all, else the pattern."""
    if rule.type == "structure":
        make: Callable = structural
    else:
        make = lambda p: (lambda test: lambda node: {} if test(node) else None)(loose(p))
    never, every, some = ([make(p) for p in x] for x in (rule.patterns_not, rule.patterns_all, rule.patterns_any))
    single = make(rule.pattern) if rule.pattern else None

    def test(node: ast.AST) -> dict[str, ast.AST] | None:
        if any(t(node) is not None for t in never):
            return None
        if some:
            return next((b for t in some if (b := t(node)) is not None), None)
        if every:
            found = [t(node) for t in every]
            return {k: v for b in found for k, v in b.items()} if None not in found else None
        return single(node) if single else None

    return test


def _found(rule: Rule, line: int | None, title: str | None = None, detail: str | None = None) -> Fact:
    return Fact(NAME, "issue", rule.id, rule.severity, title or rule.name, line, detail=detail or rule.message or rule.description or None)


def by_text(rule: Rule, source: Source) -> Iterator[Fact]:
    """The first hit of each line without an excluded text; $CAPTURE1 and so on in the message are the hit's groups. A pattern
    that is no regular expression finds nothing."""
    try:
        pattern = re.compile(rule.pattern)
    except re.error:
        return
    for no, line in enumerate(source.lines, 1):
        if (m := pattern.search(line)) and not any(x in line for x in rule.excludes):
            text = rule.message or rule.description
            for k, group in enumerate(m.groups(), 1):
                text = text.replace(f"$CAPTURE{k}", str(group))
            yield _found(rule, no, detail=text)


def _bound(rule: Rule, source: Source, node: ast.AST, bound: dict[str, ast.AST]) -> Fact:
    text = rule.message or rule.description
    for name, value in bound.items():
        text = text.replace(f"${name}", written(value, source.code))
    return _found(rule, getattr(node, "lineno", 0), detail=text)


def by_tree(rule: Rule, source: Source) -> Iterator[Fact]:
    test = _tests(rule)
    for node in source.nodes:
        if (bound := test(node)) is not None:
            yield _bound(rule, source, node, bound)


class Structures:
    """Rules of type "structure", all matched in one walk over a file. A rule is tried at nodes that may match one of its
    patterns_any, the first of its patterns_all or its pattern. One whose pattern is not Python is a fact of kind "failure" with
    its id as scope in each file, and the others go on."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        self.tests: list[Callable | None] = []
        self.broken: dict[int, Exception] = {}
        first: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            try:
                self.tests.append(_tests(rule))
                for pattern in dict.fromkeys(rule.patterns_any or rule.patterns_all[:1] or filter(None, (rule.pattern,))):
                    first.setdefault(pattern, []).append(k)
            except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError) as e:
                self.tests.append(None)
                self.broken[k] = e
        #: By pattern: rules that look where it may match
        self.wanted = list(first.values())
        self.tree = PatternTree(map(parsed, first))

    def __reduce__(self):
        return Structures, (self.rules,)  # built anew in each task

    def facts(self, source: Source) -> dict[int, list[Fact]]:
        """By a rule's place, in the order of source.nodes."""
        out = {k: [failure(NAME, e, self.rules[k].id)] for k, e in self.broken.items()}
        candidates = self.tree.candidates(source.tree) if self.wanted else {}
        for node in source.nodes if candidates else ():
            for k in sorted({k for p in candidates.get(id(node), ()) for k in self.wanted[p]}):
                if (bound := self.tests[k](node)) is not None:
                    out.setdefault(k, []).append(_bound(self.rules[k], source, node, bound))
        return out


def god_functions(source: Source) -> Iterator[tuple[int, str]]:
    for f in source.plain_functions:
        length, n = f.end_lineno - f.lineno, len(argument_names(f))
        if length > LINES:
            yield f.lineno, f"{length} lines"
        elif n > GOD_PARAMETERS:
            yield f.lineno, f"{n} parameters"


def magic_numbers(source: Source) -> Iterator[tuple[int, str]]:
    for n in source.of(ast.Constant):
        value = number(n)
        if value is not None and value not in ORDINARY:
            yield n.lineno, str(value)


def long_parameter_lists(source: Source) -> Iterator[tuple[int, str]]:
    for f in source.plain_functions:
        if len(argument_names(f)) > PARAMETERS:
            yield f.lineno, f"{f.name}: {len(argument_names(f))} parameters"


def dead_code(source: Source) -> Iterator[tuple[int, str]]:
    """Statements right after a return or raise in a function's own body."""
    for f in source.functions:
        for a, b in zip(f.body, f.body[1:]):
            if isinstance(a, (ast.Return, ast.Raise)):
                yield b.lineno, "unreachable"


#: Fixed values. Words in a smell rule's pattern; the first group that has one decides
SMELLS = ((("god", "long"), god_functions), (("magic", "number"), magic_numbers), (("param", "parameter"), long_parameter_lists), (("dead", "unreachable"), dead_code))


def by_smell(rule: Rule, source: Source) -> Iterator[Fact]:
    low = rule.pattern.lower()
    find = next((f for words, f in SMELLS if any(w in low for w in words)), None)
    for line, detail in find(source) if find else ():
        yield _found(rule, line, f"Code Smell: {rule.name}", detail)


def similar_functions(source: Source) -> int:
    """Shapes (number of positional parameters, kinds of the first five statements) that more than one function has."""
    shapes = Counter((len(f.args.args), *(type(s).__name__ for s in f.body[:5])) for f in source.plain_functions)
    return sum(n > 1 for n in shapes.values())


def flows(source: Source, sources: Iterable[str] = SOURCES, sinks: Iterable[str] = SINKS) -> Iterator[tuple[str, int]]:
    """Sink and line of each argument that comes from a source: a name assigned from a source call that breadth-first order
    meets earlier, or such a call itself."""
    sources, sinks, tainted = frozenset(sources), frozenset(sinks), set()
    queue = deque(source.nodes)
    while queue:
        node = queue.popleft()
        if isinstance(node, ast.Assign):
            if isinstance(node.value, ast.Call) and called(node.value) in sources:
                tainted.update(t.id for t in node.targets if isinstance(t, ast.Name))
        elif isinstance(node, ast.Call) and called(node) in sinks:
            for a in node.args:
                if name_of(a) in tainted or (isinstance(a, ast.Call) and called(a) in sources):
                    yield called(node), node.lineno


def by_taint(rule: Rule, source: Source) -> Iterator[Fact]:
    """With the rule's own sources and sinks besides the built-in ones; no other rule sees them."""
    for sink, line in flows(source, SOURCES.union(rule.sources), SINKS.union(rule.sinks)):
        yield _found(rule, line, f"Taint Flow: {rule.name}", sink)


KINDS = {"regex": by_text, "smell": by_smell, "taint": by_taint}


def detector(rules: Iterable[Rule], taint: bool = True, smells: bool = True) -> Callable[[Source], Iterator[Fact]]:
    rules = [r for r in rules if r.enabled]
    trees = Structures(r for r in rules if r.type == "structure")

    def detect(source: Source) -> Iterator[Fact]:
        roots = set(imports(source.nodes))
        places, found = count(), trees.facts(source)
        for rule in rules:
            place = next(places) if rule.type == "structure" else None
            if roots.issuperset(rule.requires) and not any(p in source.path for p in rule.exclude_paths):
                yield from KINDS.get(rule.type, by_tree)(rule, source) if place is None else found.get(place, ())
        if taint:
            for sink, line in flows(source):
                yield Fact(NAME, "issue", "TAINT001", "high" if sink in WORST_SINKS else "medium", "Security: Untrusted Data Flow", line, detail=sink)
        if smells and (n := similar_functions(source)) > SIMILAR:
            yield Fact(NAME, "issue", "SMELL001", "low", "Code Smell: Possible Code Duplication", None, value=float(n))

    # all that is asked of a path
    detect.view = lambda path: tuple(any(p in path for p in r.exclude_paths) for r in rules)
    return detect
