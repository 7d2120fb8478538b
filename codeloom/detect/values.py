"""Values along paths: intervals and None for local names, run over the control flow of each function to a fixed point, with
widening at loops. Finds divisions whose divisor may be zero there, uses of names that may be None there, products that leave 64
bits. What a test says of a name holds on its way alone, so guarded uses are not reported."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .cfg import Graph, essential
from .source import FUNCTION, Fact, Source, calls_name, children, measure, name_of, number

NAME = "paths"
INF = math.inf
NEVER, MAYBE, ALWAYS, UNKNOWN = "never", "maybe", "always", "unknown"
#: Visits of a step after which bounds that still move are given up
PATIENCE = 3
#: Depth up to which the parts of an expression are looked at for its value; beyond, it may be anything
DEEPEST = 100
LARGEST = 2.0**63


@dataclass(frozen=True)
class Value:
    """lo..hi if it is a number; nonzero: it is no zero; null: whether it is None (unknown: nothing is known, and nothing said);
    numeric: it is known to be a number."""

    lo: float = -INF
    hi: float = INF
    nonzero: bool = False
    null: str = UNKNOWN
    numeric: bool = False

    @property
    def may_be_zero(self) -> bool:
        return not self.nonzero and self.lo <= 0 <= self.hi

    @property
    def empty(self) -> bool:
        return self.lo > self.hi or (self.nonzero and self.lo == self.hi == 0)


ANY = Value()
NONE = Value(null=ALWAYS)
State = dict[str, Value]


def interval(lo: float, hi: float, nonzero: bool = False) -> Value:
    lo, hi = (-INF if math.isnan(lo) else lo), (INF if math.isnan(hi) else hi)
    return Value(lo, hi, nonzero or lo > 0 or hi < 0, NEVER, True)


def join(a: Value, b: Value) -> Value:
    if a == b:
        return a
    if a.null == ALWAYS:  # None has no number
        return replace(b, null=MAYBE if b.null in (NEVER, MAYBE) else b.null if b.null == ALWAYS else MAYBE)
    if b.null == ALWAYS:
        return join(b, a)
    null = a.null if a.null == b.null else MAYBE if MAYBE in (a.null, b.null) else UNKNOWN
    return Value(min(a.lo, b.lo), max(a.hi, b.hi), (a.nonzero or not a.lo <= 0 <= a.hi) and (b.nonzero or not b.lo <= 0 <= b.hi), null, a.numeric and b.numeric)


def joined(a: State | None, b: State | None) -> State | None:
    if a is None or b is None:
        return b if a is None else a
    return {n: join(a[n], b[n]) for n in a.keys() & b.keys()}


def widened(old: State, new: State) -> State:
    out = {}
    for n in old.keys() & new.keys():
        a, b = old[n], new[n]
        out[n] = replace(b, lo=b.lo if b.lo >= a.lo else -INF, hi=b.hi if b.hi <= a.hi else INF)
    return out


def _product(a: float, b: float) -> float:
    return 0.0 if a == 0 or b == 0 else a * b


def arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    if not (a.numeric and b.numeric):
        return ANY
    match op:
        case ast.Add():
            return interval(a.lo + b.lo, a.hi + b.hi)
        case ast.Sub():
            return interval(a.lo - b.hi, a.hi - b.lo)
        case ast.Mult():
            ends = [_product(x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
            return interval(min(ends), max(ends), not a.may_be_zero and not b.may_be_zero)
        case ast.Mod() if b.lo > 0:
            return interval(0, b.hi if math.isinf(b.hi) else max(0.0, b.hi))
        case ast.Pow() if a.lo >= 1 and b.lo >= 0:
            try:
                return interval(a.lo**b.lo, a.hi**b.hi)
            except OverflowError:
                return interval(a.lo, INF)
        case ast.FloorDiv() if a.lo >= 0 and b.lo >= 1:
            return interval(0, a.hi if math.isinf(a.hi) else a.hi // b.lo)
    return Value(numeric=False, null=NEVER)


def value(node: ast.expr, state: State, depth: int = 0) -> Value:
    if depth > DEEPEST:
        return ANY
    inner = lambda n: value(n, state, depth + 1)
    match node:
        case ast.Constant(value=None):
            return NONE
        case ast.Constant():
            n = node.value if isinstance(node.value, bool) else number(node)
            return Value(null=NEVER) if n is None or isinstance(n, complex) or abs(n) > 1e300 else interval(n, n)
        case ast.Name():
            return state.get(node.id, ANY)
        case ast.NamedExpr():
            return inner(node.value)
        case ast.BinOp():
            left = inner(node.left)
            return arithmetic(node.op, left, inner(node.right))
        case ast.UnaryOp(op=ast.USub()):
            v = inner(node.operand)
            return interval(-v.hi, -v.lo, v.nonzero) if v.numeric else ANY
        case ast.UnaryOp(op=ast.Not()) | ast.Compare():
            return Value(0, 1, null=NEVER)
        case ast.BoolOp():
            out, before = None, dict(state)
            for k, part in enumerate(node.values):
                v = value(part, before, depth + 1)
                last = k == len(node.values) - 1
                stays = v if last else truthy(v) if isinstance(node.op, ast.Or) else falsy(v)
                if not stays.empty:
                    out = stays if out is None else join(out, stays)
                before = assume(part, isinstance(node.op, ast.And), before, depth + 1)
                if before is None:
                    break
            return out or ANY
        case ast.IfExp():
            yes, no = assume(node.test, True, state, depth + 1), assume(node.test, False, state, depth + 1)
            found = [value(n, s, depth + 1) for n, s in ((node.body, yes), (node.orelse, no)) if s is not None]
            return join(found[0], found[-1]) if found else ANY
        case ast.Call() if isinstance(node.func, ast.Name) and not node.keywords:
            args = [inner(a) for a in node.args]
            match node.func.id, args:
                case "len", [_]:
                    return interval(0, INF)
                case "abs", [v] if v.numeric:
                    return interval(0 if v.lo <= 0 <= v.hi else min(abs(v.lo), abs(v.hi)), max(abs(v.lo), abs(v.hi)), v.nonzero)
                case "max", [_, _, *_] if all(v.numeric for v in args):
                    return interval(max(v.lo for v in args), max(v.hi for v in args))
                case "min", [_, _, *_] if all(v.numeric for v in args):
                    return interval(min(v.lo for v in args), min(v.hi for v in args))
            return ANY
        case ast.List() | ast.Tuple() | ast.Dict() | ast.Set() | ast.JoinedStr() | ast.ListComp() | ast.DictComp() | ast.SetComp() | ast.Lambda():
            return Value(null=NEVER)
    return ANY


def truthy(v: Value) -> Value:
    return replace(v, nonzero=True, null=NEVER if v.null != ALWAYS else ALWAYS, lo=INF if v.null == ALWAYS else v.lo, hi=-INF if v.null == ALWAYS else v.hi)


def falsy(v: Value) -> Value:
    """Zero, None, or something empty."""
    if v.null == ALWAYS:
        return v
    if v.numeric and v.null == NEVER:
        return replace(v, lo=max(v.lo, 0.0), hi=min(v.hi, 0.0))
    return v if not v.nonzero else replace(v, null=ALWAYS) if v.null == MAYBE else v


_FLIPPED = {ast.Lt: ast.Gt, ast.LtE: ast.GtE, ast.Gt: ast.Lt, ast.GtE: ast.LtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq}
_OPPOSITE = {ast.Lt: ast.GtE, ast.LtE: ast.Gt, ast.Gt: ast.LtE, ast.GtE: ast.Lt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Is: ast.IsNot, ast.IsNot: ast.Is}


def compared(v: Value, op: type, other: Value) -> Value:
    """v, given that it compares so with the other value. Bounds stay closed: floats may be as close as they like, and only zero
    matters."""
    if other.null == ALWAYS:
        if op in (ast.Is, ast.Eq):
            return v if v.null == ALWAYS else NONE if v.null in (MAYBE, UNKNOWN) else replace(v, lo=INF, hi=-INF)
        if op in (ast.IsNot, ast.NotEq):
            return replace(v, lo=INF, hi=-INF) if v.null == ALWAYS else replace(v, null=NEVER)
        return v
    if not other.numeric:
        return v
    if op in (ast.Lt, ast.LtE):
        return replace(v, hi=min(v.hi, other.hi), nonzero=v.nonzero or (other.hi <= 0 if op is ast.Lt else other.hi < 0), null=NEVER)
    if op in (ast.Gt, ast.GtE):
        return replace(v, lo=max(v.lo, other.lo), nonzero=v.nonzero or (other.lo >= 0 if op is ast.Gt else other.lo > 0), null=NEVER)
    if op is ast.Eq:
        return Value(max(v.lo, other.lo), min(v.hi, other.hi), v.nonzero or not other.may_be_zero, NEVER, True)
    if op is ast.NotEq and other.lo == other.hi == 0:
        return replace(v, nonzero=True)
    return v


def assume(test: ast.expr, truth: bool, state: State, depth: int = 0) -> State | None:
    """The state where the test came out so; null if it cannot."""
    if depth > DEEPEST:
        return dict(state)
    match test:
        case ast.UnaryOp(op=ast.Not()):
            return assume(test.operand, not truth, state, depth + 1)
        case ast.BoolOp():
            every = isinstance(test.op, ast.And) == truth
            now: State | None = dict(state)
            out: State | None = None
            for part in test.values:
                if now is None:
                    break
                if every:
                    now = assume(part, truth, now, depth + 1)
                else:
                    out = joined(out, assume(part, truth, now, depth + 1))
                    now = assume(part, not truth, now, depth + 1)
            return now if every else out
        case ast.NamedExpr():
            state = {**state, test.target.id: value(test.value, state)}
            return _narrowed(state, test.target.id, truthy if truth else falsy)
        case ast.Name():
            return _narrowed(state, test.id, truthy if truth else falsy)
        case ast.Constant():
            return dict(state) if bool(test.value) == truth else None
        case ast.Compare():
            pairs = list(zip([test.left, *test.comparators], test.ops, test.comparators))
            if not truth and len(pairs) > 1:
                return dict(state)
            now = dict(state)
            for left, op, right in pairs:
                kind = type(op) if truth else _OPPOSITE.get(type(op))
                for name, how, other in ((name_of(left), kind, right), (name_of(right), _FLIPPED.get(kind), left)):
                    if name and how and now is not None:
                        v = value(other, now, depth + 1)
                        now = _narrowed(now, name, lambda x, how=how, v=v: compared(x, how, v))
                if now is None:
                    return None
            return now
        case ast.Call() if calls_name(test, "isinstance") and truth and test.args:
            return _narrowed(state, name_of(test.args[0]), lambda v: replace(v, null=NEVER))
    return dict(state)


def _narrowed(state: State, name: str | None, how) -> State | None:
    if name is None:
        return dict(state)
    v = how(state.get(name, ANY))
    return None if v.empty else {**state, name: v}


def targets(node: ast.AST) -> Iterator[str]:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, ast.Name):
            yield at.id
        elif isinstance(at, (ast.Tuple, ast.List)):
            stack += at.elts
        elif isinstance(at, ast.Starred):
            stack.append(at.value)


def _bound(parts: list[ast.AST]) -> Iterator[ast.NamedExpr]:
    """Assignments within expressions."""
    for part in parts:
        stack = [part]
        while stack:
            at = stack.pop()
            if isinstance(at, ast.NamedExpr):
                yield at
            if not isinstance(at, (ast.Lambda, *FUNCTION, ast.ClassDef)):
                stack += [c for c in children(at) if not isinstance(c, ast.stmt)]


def after(kind: str, node: ast.AST | None, state: State) -> State:
    """The state after a step."""
    out = dict(state)
    for n in _bound([] if node is None or kind in ("handler", "match") else expressions(kind, node)):
        out[n.target.id] = ANY
    match node:
        case ast.Assign():
            v = value(node.value, state)
            for t in node.targets:
                if isinstance(t, ast.Name):
                    out[t.id] = v
                else:
                    out.update(dict.fromkeys(targets(t), ANY))
        case ast.AnnAssign() if isinstance(node.target, ast.Name) and node.value is not None:
            out[node.target.id] = value(node.value, state)
        case ast.AugAssign() if isinstance(node.target, ast.Name):
            out[node.target.id] = arithmetic(node.op, value(node.target, state), value(node.value, state))
        case ast.With() | ast.AsyncWith():
            out.update({n: ANY for i in node.items if i.optional_vars is not None for n in targets(i.optional_vars)})
        case ast.ExceptHandler() if node.name:
            out[node.name] = Value(null=NEVER)
        case ast.Import() | ast.ImportFrom():
            out.update({(a.asname or a.name).split(".")[0]: Value(null=NEVER) for a in node.names})
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            out[node.name] = Value(null=NEVER)
        case ast.Match():
            out.update({n: ANY for p in ast.walk(node) if (n := getattr(p, "name", None) or getattr(p, "rest", None)) and isinstance(n, str)})
        case ast.Delete():
            out.update({n: ANY for t in node.targets for n in targets(t)})
    return out


def expressions(kind: str, node: ast.AST) -> list[ast.AST]:
    """What a step evaluates."""
    match node:
        case ast.If() | ast.While():
            return [node.test]
        case ast.For() | ast.AsyncFor():
            return [node.iter]
        case ast.With() | ast.AsyncWith():
            return [i.context_expr for i in node.items]
        case ast.Match():
            return [node.subject]
        case ast.ExceptHandler():
            return [node.type] if node.type else []
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return list(node.decorator_list)
    return [c for c in children(node) if not isinstance(c, ast.stmt)]


def drawn(node: ast.For | ast.AsyncFor, state: State) -> State:
    """The state in the body of a loop: what range() gives is known."""
    out = {**state, **dict.fromkeys(targets(node.target), ANY)}
    it = node.iter
    if isinstance(node.target, ast.Name) and calls_name(it, "range") and 1 <= len(it.args) <= 2 and not it.keywords:
        ends = [value(a, state) for a in it.args]
        first = interval(0, 0) if len(ends) == 1 else ends[0]
        v = interval(first.lo if first.numeric else -INF, ends[-1].hi - 1 if ends[-1].numeric else INF)
        out[node.target.id] = v if not v.empty else ANY
    elif isinstance(node.target, ast.Tuple) and calls_name(it, "enumerate") and len(it.args) == 1 and isinstance(node.target.elts[0], ast.Name):
        out[node.target.elts[0].id] = interval(0, INF)
    return out


def states_of(graph: Graph, start: State, fixed: set[str]) -> list[State | None]:
    """The state before each step; null: no way leads there. fixed: names that other scopes may set, of which nothing is known."""
    before: list[State | None] = [None] * len(graph.steps)
    visits = [0] * len(graph.steps)
    before[graph.start] = start
    waiting = [graph.start]
    while waiting:
        k = waiting.pop()
        step, state = graph.steps[k], before[k]
        done = {n: v for n, v in after(step.kind, step.node, state).items() if n not in fixed}
        sent = [(to, state) for to in step.failing] + [(to, done) for to in step.failing]
        for to, test, truth in step.edges:
            if step.kind == "for" and truth:
                sent.append((to, drawn(step.node, done)))
            else:
                sent.append((to, done if test is None else assume(test, truth, done)))
        for to, new in sent:
            if new is None:
                continue
            new = {n: v for n, v in new.items() if n not in fixed}
            old = before[to]
            both = new if old is None else joined(old, new)
            if both != old:
                visits[to] += 1
                before[to] = both if old is None or visits[to] <= PATIENCE else widened(old, both)
                if before[to] != old:
                    waiting.append(to)
    return before


def uses(parts: list[ast.AST], state: State) -> Iterator[tuple[str, ast.AST, str, Value]]:
    """division, none and overflow with their place, name and value, in expressions; what `and`, `or` and conditions within
    them say holds in them."""
    stack: list[tuple[ast.AST, State | None]] = [(p, state) for p in reversed(parts)]
    while stack:
        node, now = stack.pop()
        if now is None or isinstance(node, (ast.Lambda, *FUNCTION, ast.ClassDef)):
            continue
        match node:
            case ast.BoolOp():
                for part in node.values:
                    stack.append((part, now))
                    now = assume(part, isinstance(node.op, ast.And), now) if now is not None else None
                continue
            case ast.IfExp():
                stack += [(node.test, now), (node.body, assume(node.test, True, now)), (node.orelse, assume(node.test, False, now))]
                continue
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                for g in node.generators:
                    stack.append((g.iter, now))
                    now = {n: v for n, v in (now or {}).items() if n not in set(targets(g.target))}
                    for test in g.ifs:
                        if now is not None:
                            stack.append((test, now))
                            now = assume(test, True, now)
                stack += [(e, now) for e in ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])]
                continue
            case ast.BinOp(op=ast.Div() | ast.FloorDiv() | ast.Mod(), right=ast.Name()):
                v = value(node.right, now)
                if v.may_be_zero and not (isinstance(node.op, ast.Mod) and isinstance(node.left, (ast.Constant, ast.JoinedStr)) and number(node.left) is None):
                    yield "division", node, node.right.id, v
            case ast.BinOp(op=ast.Mult() | ast.Pow()):
                v = value(node, now)
                if v.numeric and (v.lo > LARGEST or v.hi < -LARGEST or LARGEST < v.hi < INF or -INF < v.lo < -LARGEST):
                    yield "overflow", node, "", v
            case ast.Attribute() | ast.Subscript() if isinstance(node.value, ast.Name):
                v = value(node.value, now)
                if v.null in (MAYBE, ALWAYS):
                    yield "none", node, node.value.id, v
        stack += [(c, now) for c in reversed(children(node)) if not isinstance(c, ast.stmt)]


def _shared(body: list[ast.AST]) -> set[str]:
    """Names that an inner function or a declaration lets others set."""
    out: set[str] = set()
    stack = list(body)
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            out.update(n.names)
        stack += children(n)
    return out


def check(body: list[ast.stmt], start: State) -> Iterator[tuple[str, int, str, Value]]:
    """kind, line, name, value of every finding in a body, by place."""
    graph = Graph(body)
    before = states_of(graph, start, _shared(body))
    seen = set()
    for step, state in zip(graph.steps, before):
        if state is None or step.node is None:
            continue
        parts = expressions(step.kind, step.node)
        if isinstance(step.node, ast.AugAssign):
            made = ast.copy_location(ast.BinOp(step.node.target, step.node.op, step.node.value), step.node)
            parts = [made]
        for kind, node, name, v in uses(parts, state):
            key = kind, node.lineno, node.col_offset, name
            if key not in seen:
                seen.add(key)
                yield kind, node.lineno, name, v


def given(f: ast.AST) -> State:
    """What is known of parameters: those that default to None may be None."""
    a = f.args
    positional = [*a.posonlyargs, *a.args]
    defaults = [*zip(reversed(positional), reversed(a.defaults)), *((k, d) for k, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None)]
    return {p.arg: Value(null=MAYBE) for p, d in defaults if isinstance(d, ast.Constant) and d.value is None}


def detect(source: Source) -> Iterator[Fact]:
    bodies = [("", source.tree.body, {})] + [(f.name, f.body, given(f)) for f in source.functions]
    for scope, body, start in bodies:
        for kind, line, name, v in sorted(check(body, start), key=lambda x: (x[1], x[0], x[2])):
            if kind == "division":
                always = v.numeric and v.lo == v.hi == 0
                yield Fact(NAME, "issue", "PATH_DIVISION", "critical" if always else "high", f"Division by Zero: {name}" if always else f"Division by Zero Risk: {name}", line, scope=scope)
            elif kind == "none":
                yield Fact(NAME, "issue", "PATH_NONE", "high" if v.null == ALWAYS else "medium", f"Use of None: {name}" if v.null == ALWAYS else f"Missing None Check: {name}", line, scope=scope)
            else:
                yield Fact(NAME, "issue", "PATH_OVERFLOW", "low", "Numeric Overflow of 64 Bits", line, scope=scope)
    for f in source.functions:
        yield measure(NAME, "essential", essential(f), f.name, f.lineno)
