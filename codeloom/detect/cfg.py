"""Control flow of a function as a graph of statements and tests, and its reduction to what is not structured."""

from __future__ import annotations

import ast
from collections.abc import Collection
from dataclasses import dataclass, field

#: An edge: where it leads, the test that it depends on (or null), and how that came out
Edge = tuple[int, ast.expr | None, bool]


@dataclass
class Step:
    """A simple statement, a test (kind "test"), a loop's head ("for"), or a place where ways meet. Edges of `failing` are taken if
    the step fails."""

    kind: str
    node: ast.AST | None = None
    edges: list[Edge] = field(default_factory=list)
    failing: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Around:
    """Where break, continue, return and raise lead."""

    end: int
    fail: int
    out: int | None = None
    again: int | None = None


class Graph:
    """each_fails: any step of a try may lead to its handlers; else they are branches at its start. single: statements that count as
    one step, whatever is in them."""

    def __init__(self, body: list[ast.stmt], each_fails: bool = True, single: Collection[ast.stmt] = ()):
        self.steps: list[Step] = []
        self.each_fails, self.single = each_fails, single
        self.end = self._step("end")
        self.start = self._body(body, self.end, Around(self.end, self.end))

    def _step(self, kind: str, node: ast.AST | None = None, *edges: Edge) -> int:
        self.steps.append(Step(kind, node, list(edges)))
        return len(self.steps) - 1

    def _body(self, body: list[ast.stmt], after: int, around: Around) -> int:
        """The first step of statements that lead to `after`. Built from the last one on."""
        for s in reversed(body):
            after = self._statement(s, after, around)
        return after

    def _statement(self, s: ast.stmt, after: int, around: Around) -> int:
        if s in self.single:
            return self._step("do", s, (after, None, True))
        match s:
            case ast.If():
                chain = _chain(s)
                at = self._body(chain[-1].orelse, after, around)
                for branch in reversed(chain):
                    at = self._step("test", branch, (self._body(branch.body, after, around), branch.test, True), (at, branch.test, False))
            case ast.While():
                at = self._step("test", s)
                inner = Around(around.end, around.fail, after, at)
                no = self._body(s.orelse, after, around)
                # `while True` has no way out but break
                always = isinstance(s.test, ast.Constant) and bool(s.test.value)
                self.steps[at].edges = [(self._body(s.body, at, inner), s.test, True)] + ([] if always else [(no, s.test, False)])
            case ast.For() | ast.AsyncFor():
                at = self._step("for", s)
                inner = Around(around.end, around.fail, after, at)
                self.steps[at].edges = [(self._body(s.body, at, inner), None, True), (self._body(s.orelse, after, around), None, False)]
            case ast.Try() | ast.TryStar():
                return self._try(s, after, around)
            case ast.With() | ast.AsyncWith():
                at = self._step("with", s, (self._body(s.body, after, around), None, True))
            case ast.Match():
                cases = [(self._body(c.body, after, around), None, True) for c in s.cases]
                last = s.cases[-1]
                whole = isinstance(last.pattern, ast.MatchAs) and last.pattern.pattern is None and last.guard is None
                at = self._step("match", s, *cases, *([] if whole else [(after, None, False)]))
            case ast.Break() if around.out is not None:
                at = self._step("jump", s, (around.out, None, True))
            case ast.Continue() if around.again is not None:
                at = self._step("jump", s, (around.again, None, True))
            case ast.Return():
                at = self._step("return", s, (around.end, None, True))
            case ast.Raise():
                at = self._step("raise", s, (around.fail, None, True))
            case _:
                at = self._step("do", s, (after, None, True))
        return at

    def _try(self, s: ast.Try, after: int, around: Around) -> int:
        if s.finalbody:
            # what leaves the try passes its last block, a copy of it for each way out
            leave = lambda to: None if to is None else self._body(s.finalbody, to, around)
            done = self._body(s.finalbody, after, around)
            around = Around(leave(around.end), leave(around.fail), leave(around.out), leave(around.again))
        else:
            done = after
        handlers = [self._step("handler", h, (self._body(h.body, done, around), None, True)) for h in s.handlers]
        fail = self._step("meet", None, *((h, None, True) for h in handlers)) if handlers else around.fail
        inside = Around(around.end, fail, around.out, around.again)
        first = len(self.steps)
        at = self._body(s.body, self._body(s.orelse, done, around), inside)
        if not handlers and not s.finalbody:
            return at
        if self.each_fails:
            for step in self.steps[first:]:
                step.failing.append(fail)
            return self._step("try", None, (at, None, True))
        return self._step("try", None, (at, None, True), *((h, None, True) for h in handlers))

    def reachable(self) -> set[int]:
        seen, stack = {self.start}, [self.start]
        while stack:
            step = self.steps[stack.pop()]
            for to in (*(e[0] for e in step.edges), *step.failing):
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return seen


def essential(function: ast.AST) -> int:
    """McCabe's essential complexity: 1 and, for every statement with one way in and one way out, what is left of its graph when all
    that is structured in it has been reduced to single steps. 1 for structured code; what stands around a statement that is
    not structured does not change its share."""
    single: set[ast.stmt] = set()
    left = 0

    def leaving(s: ast.stmt) -> set[type]:
        """The jumps that lead out of a statement."""
        nonlocal left
        if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            return {type(s)}
        bodies = [s.body for s in _chain(s)] + [_chain(s)[-1].orelse] if isinstance(s, ast.If) else [getattr(s, n, []) for n in ("body", "orelse", "finalbody")]
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or not any(bodies) and not isinstance(s, ast.Match):
            return set()
        bodies += [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
        out: set[type] = set()
        for k, body in enumerate(bodies):
            inner = set().union(*map(leaving, body))
            out |= inner - {ast.Break, ast.Continue} if k == 0 and isinstance(s, (ast.For, ast.AsyncFor, ast.While)) else inner
        if not out:
            left += _irreducible([s], single) - 1
            single.add(s)
        return out

    for s in function.body:
        leaving(s)
    return _irreducible(function.body, single) + left


def _chain(s: ast.If) -> list[ast.If]:
    """An if and what its elifs are."""
    out = [s]
    while len(out[-1].orelse) == 1 and isinstance(out[-1].orelse[0], ast.If):
        out.append(out[-1].orelse[0])
    return out


def _irreducible(body: list[ast.stmt], single: Collection[ast.stmt]) -> int:
    """The cyclomatic number of the graph that is left when sequences, branches that meet again and loops with one way in and out
    have been reduced to a step each, over and over."""
    graph = Graph(body, each_fails=False, single=single)
    alive = graph.reachable() | {graph.end}
    out: dict[int, set[int]] = {k: {e[0] for e in graph.steps[k].edges} for k in alive}
    into: dict[int, set[int]] = {k: set() for k in alive}
    for k, targets in out.items():
        for t in targets:
            into[t].add(k)

    def merge(a: int, b: int) -> set[int]:
        """b, which a alone leads to, becomes part of a; the steps that may be reducible now."""
        out[a].discard(b)
        for t in out.pop(b):
            into[t].discard(b)
            out[a].add(t)
            into[t].add(a)
        del into[b]
        return {a, *out[a], *into[a]}

    waiting = set(out)
    while waiting:
        n = waiting.pop()
        if n not in out:
            continue
        if n in out[n]:  # a loop with one step
            out[n].discard(n)
            into[n].discard(n)
            waiting |= {n, *into[n], *out[n]}
            continue
        single = [t for t in out[n] if into[t] == {n} and t != graph.end and t != n]
        if len(out[n]) == 1 and single:
            waiting |= merge(n, single[0])
            continue
        for t in single:
            # a branch that leads where the others do, back to the head, or nowhere
            if out[t] <= {n} or (len(out[t]) == 1 and (out[t] & out[n] or any(u != t and out[u] == out[t] for u in single))):
                waiting |= merge(n, t)
                break
    edges = sum(map(len, out.values()))
    return max(1, edges - len(out) + 2)

