"""What flows where within each function: from its parameters, untrusted sources and results of calls to its own result, to sinks
and to arguments of calls. Operators join these facts over the call graph (operators/taint.py).

A fact of kind "flow" has the function as scope, where it comes from as name and where it goes as detail:
 from  p|parameter, s|line|source, c|place of a call
 to    r (the result), k|kind|line|sink, a|place of a call|key (#0, #1 ... by position, else the keyword; . is the object called on)
Facts of kind "parameter" have the keys under which a caller reaches a parameter (name) and the parameter (detail)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .security import SANITIZERS, SINKS, SOURCES
from .source import FUNCTION, Fact, Source, attribute_tail, children, dotted
from .symbols import place, scoped, written

NAME = "flows"
State = dict[str, frozenset[str]]
NOTHING: frozenset[str] = frozenset()


def _ends(name: str, known: tuple[str, ...]) -> bool:
    return any(name == k or name.endswith("." + k) for k in known)


def merged(*states: State) -> State:
    out: State = {}
    for state in states:
        for name, origins in state.items():
            out[name] = out.get(name, NOTHING) | origins
    return out


class Flows:
    """One function or module body, run over sets of origins: branches are joined, loops are repeated until nothing is new."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, str, int], None] = {}  # in order

    def origins(self, node: ast.AST | None, state: State) -> frozenset[str]:
        """Where the value of an expression comes from. No recursion: expressions may be deep."""
        out: set[str] = set()
        stack = [node] if node is not None else []
        while stack:
            at = stack.pop()
            if isinstance(at, ast.Name):
                out |= state.get(at.id, NOTHING)
            elif isinstance(at, ast.Attribute):
                tail = attribute_tail(at)
                if _ends(tail, SOURCES):
                    out.add(f"s|{at.lineno}|{tail}")
                elif (name := written(at)) in state:
                    out |= state[name]
                    continue
                stack.append(at.value)
            elif isinstance(at, ast.Call):
                name = dotted(at)
                if _ends(name, SANITIZERS):
                    continue
                if _ends(name, SOURCES):
                    out.add(f"s|{at.lineno}|{name}")
                out.add(f"c|{place(at)}")  # what it hands through is known once it is known what is called
            elif isinstance(at, ast.comprehension):
                stack.append(at.iter)
            elif not isinstance(at, (ast.Lambda, ast.Compare, *FUNCTION, ast.ClassDef)):
                stack += [c for c in children(at) if isinstance(c, (ast.expr, ast.comprehension))]
        return frozenset(out)

    def note(self, origins: frozenset[str], to: str, line: int) -> None:
        for o in sorted(origins):
            self.found.setdefault((o, to, line))

    def evaluate(self, node: ast.AST | None, state: State) -> frozenset[str]:
        """As origins(), noting what goes into the calls and sinks inside."""
        stack = [node] if node is not None else []
        while stack:
            at = stack.pop()
            if isinstance(at, (ast.Lambda, *FUNCTION, ast.ClassDef)):
                continue
            if isinstance(at, ast.NamedExpr):
                state[at.target.id] = self.origins(at.value, state)
            elif isinstance(at, ast.comprehension):
                self.assign(at.target, self.origins(at.iter, state), state)
            elif isinstance(at, ast.Call):
                name, here = dotted(at), place(at)
                given = [(f"#{k}", a) for k, a in enumerate(at.args)] + [(k.arg or "**", k.value) for k in at.keywords]
                if isinstance(at.func, ast.Attribute):
                    given.append((".", at.func.value))
                sinks = [kind for kind, known in SINKS.items() if _ends(name, known)]
                for key, value in given:
                    if came := self.origins(value, state):
                        self.note(came, f"a|{here}|{key}", at.lineno)
                        for kind in sinks if key.startswith("#") else ():
                            self.note(came, f"k|{kind}|{at.lineno}|{name}", at.lineno)
            stack += children(at)
        return self.origins(node, state)

    def assign(self, target: ast.AST, origins: frozenset[str], state: State) -> None:
        """Names and attributes take over what is assigned to them, elements add to the whole."""
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign(t, origins, state)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, origins, state)
        elif isinstance(target, ast.Subscript):
            if name := written(target.value):
                state[name] = state.get(name, NOTHING) | origins
        elif name := written(target):
            state[name] = origins

    def run(self, body: list[ast.stmt], state: State) -> State:
        for s in body:
            state = self.statement(s, state)
        return state

    def repeated(self, s: ast.For | ast.AsyncFor | ast.While, state: State) -> State:
        while True:
            inner = dict(state)
            if isinstance(s, ast.While):
                self.evaluate(s.test, inner)
            else:
                self.assign(s.target, self.evaluate(s.iter, inner), inner)
            after = merged(state, self.run(s.body, inner))
            if after == state:
                return self.run(s.orelse, dict(state))
            state = after

    def statement(self, s: ast.stmt, state: State) -> State:
        match s:
            case ast.Assign():
                came = self.evaluate(s.value, state)
                for t in s.targets:
                    self.assign(t, came, state)
            case ast.AnnAssign() if s.value is not None:
                self.assign(s.target, self.evaluate(s.value, state), state)
            case ast.AugAssign():
                self.assign(s.target, self.evaluate(s.value, state) | self.origins(s.target, state), state)
            case ast.Return():
                self.note(self.evaluate(s.value, state), "r", s.lineno)
            case ast.Expr() if isinstance(s.value, (ast.Yield, ast.YieldFrom)):
                self.note(self.evaluate(s.value, state), "r", s.lineno)
            case ast.If():
                ends = []
                while True:  # a chain of elif is deep
                    self.evaluate(s.test, state)
                    ends.append(self.run(s.body, dict(state)))
                    if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If):
                        s = s.orelse[0]
                        continue
                    return merged(*ends, self.run(s.orelse, dict(state)))
            case ast.For() | ast.AsyncFor() | ast.While():
                return self.repeated(s, state)
            case ast.With() | ast.AsyncWith():
                for item in s.items:
                    came = self.evaluate(item.context_expr, state)
                    if item.optional_vars is not None:
                        self.assign(item.optional_vars, came, state)
                return self.run(s.body, state)
            case ast.Try() | ast.TryStar():
                tried = self.run(s.body, dict(state))
                ends = [self.run(s.orelse, dict(tried))]
                ends += [self.run(h.body, merged(state, tried)) for h in s.handlers]
                return self.run(s.finalbody, merged(*ends))
            case ast.Match():
                came = self.evaluate(s.subject, state)
                ends = [state]
                for c in s.cases:
                    inner = dict(state)
                    for n in ast.walk(c.pattern):
                        if name := getattr(n, "name", None) or getattr(n, "rest", None):
                            inner[name] = came
                    ends.append(self.run(c.body, inner))
                return merged(*ends)
            case ast.ClassDef():
                return self.run(s.body, state)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                pass
            case _:
                for c in children(s):
                    if isinstance(c, ast.expr):
                        self.evaluate(c, state)
        return state


def detect(source: Source) -> Iterator[Fact]:
    bodies = [("", source.tree, False)]
    for node, scope, owner in scoped(source.tree):
        if isinstance(node, FUNCTION):
            still = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
            bodies.append((f"{scope}.{node.name}" if scope else node.name, node, bool(owner) and scope == owner and not still))
    for scope, root, bound in bodies:
        state: State = {}
        if scope:
            a = root.args
            names = [x.arg for x in (*a.posonlyargs, *a.args)]
            keys = [(".", names[0])] if bound and names else []
            keys += [(f"#{k}", n) for k, n in enumerate(names[1:] if bound else names)]
            keys += [(x.arg, x.arg) for x in (*a.args, *a.kwonlyargs)]
            for key, name in dict.fromkeys(keys):
                yield Fact(NAME, "parameter", key, scope=scope, line_number=root.lineno, detail=name)
            state = {x.arg: frozenset((f"p|{x.arg}",)) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
        flows = Flows()
        flows.run(root.body, state)
        for came, to, line in flows.found:
            yield Fact(NAME, "flow", came, line_number=line, scope=scope, detail=to)
