"""Many tree patterns over a file in one walk: a discrimination tree over the patterns, read against the file's tree as a flat row
of symbols. What it finds is a superset of the matches, as metavariables are not compared with each other there; the few nodes
that it finds are then matched exactly."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from typing import Any

#: Fields that no pattern compares
UNCOMPARED = frozenset(("ctx", "type_comment", "type_params"))
META = "METAVARIABLE_"
#: Symbols of every row: the ends of a list, and what no pattern holds
CLOSE, OPEN, OTHER = 0, 1, 2


def dots(x: Any) -> bool:
    """Whether a pattern's node is `...`."""
    return isinstance(x, ast.Constant) and x.value is Ellipsis


def fields(node: ast.AST) -> Iterator[Any]:
    return (getattr(node, name, None) for name in node._fields if name not in UNCOMPARED)


class Flat:
    """A file's tree in preorder. symbols: a number for each node, list end and plain value; ends: where what begins there is
    over; expression: whether it is one, which metavariables stand for. Deep trees need no stack."""

    def __init__(self, tree: ast.AST, numbers: dict[Any, int]):
        self.symbols: list[int] = []
        self.ends: list[int] = []
        self.expression = bytearray()
        #: Expressions and statements with their places
        self.nodes: list[tuple[ast.AST, int]] = []
        find, symbols, ends = numbers.get, self.symbols, self.ends
        todo: list[tuple[bool, Any]] = [(True, tree)]
        while todo:
            enter, x = todo.pop()
            at = len(symbols)
            if not enter:  # the end of what began at x
                if symbols[x] == OPEN:
                    symbols.append(CLOSE)
                    self.expression.append(0)
                    ends.append(at + 1)
                    at += 1
                ends[x] = at
                continue
            expression = isinstance(x, ast.expr)
            self.expression.append(expression)
            ends.append(at + 1)
            if isinstance(x, ast.AST):
                symbols.append(find(type(x), OTHER))
                if expression or isinstance(x, ast.stmt):
                    self.nodes.append((x, at))
                below = list(fields(x))
            elif isinstance(x, list):
                symbols.append(OPEN)
                below = x
            else:
                symbols.append(find((type(x), x), OTHER))
                continue
            todo.append((False, at))
            todo += [(True, y) for y in reversed(below)]


class PatternTree:
    """Parsed patterns by their rows of symbols; common beginnings are one path. A metavariable or `...` for an expression is a
    step over one expression, `...` in a list is a step over any number of elements. Paths are rows of whole nodes, so no
    pattern's path goes on where another's ends."""

    def __init__(self, patterns: Iterable[ast.AST]):
        self.numbers: dict[Any, int] = {}
        #: Of each state: where a symbol leads, where an expression leads, where elements to be skipped lead, patterns that end
        self.steps: list[dict[int, int]] = []
        self.over: list[int] = []
        self.gap: list[int] = []
        self.done: list[list[int]] = []
        self._state()
        for k, pattern in enumerate(patterns):
            self._add(pattern, k)

    def _state(self) -> int:
        self.steps.append({})
        self.over.append(0)
        self.gap.append(0)
        self.done.append([])
        return len(self.steps) - 1

    def _along(self, state: int, symbol: int) -> int:
        if symbol not in self.steps[state]:
            self.steps[state][symbol] = self._state()
        return self.steps[state][symbol]

    def _kept(self, states: list[int], state: int) -> int:
        states[state] = states[state] or self._state()
        return states[state]

    def _number(self, key: Any) -> int:
        return self.numbers.setdefault(key, len(self.numbers) + OTHER + 1)

    def _add(self, pattern: ast.AST, k: int) -> None:
        state, todo = 0, [(pattern, False)]
        while todo:
            x, in_list = todo.pop()
            if x is CLOSE and in_list is None:
                state = self._along(state, CLOSE)
            elif in_list and (dots(x) or (isinstance(x, ast.Expr) and dots(x.value))):
                state = self._kept(self.gap, state)
            elif dots(x) or (isinstance(x, ast.Name) and x.id.startswith(META)):
                state = self._kept(self.over, state)
            elif isinstance(x, ast.AST):
                state = self._along(state, self._number(type(x)))
                todo += [(y, False) for y in reversed(list(fields(x)))]
            elif isinstance(x, list):
                state = self._along(state, OPEN)
                todo += [(CLOSE, None), *((y, True) for y in reversed(x))]
            else:
                state = self._along(state, self._number((type(x), x)))
        self.done[state].append(k)

    def found(self, flat: Flat, start: int) -> set[int]:
        """Patterns that the node at a place may match: all that it matches and those that differ in metavariables alone."""
        steps, over, gap, done = self.steps, self.over, self.gap, self.done
        symbols, ends, expression = flat.symbols, flat.ends, flat.expression
        out: set[int] = set()
        if not over[0] and symbols[start] not in steps[0]:
            return out
        todo, seen = [(0, start)], set()
        while todo:
            state, at = todo.pop()
            if done[state]:
                out.update(done[state])
                continue
            symbol = symbols[at]
            if symbol in steps[state]:
                todo.append((steps[state][symbol], at + 1))
            if over[state] and expression[at]:
                todo.append((over[state], ends[at]))
            if gap[state]:
                while (state, at) not in seen:  # from there on, the rest of the list has been tried
                    seen.add((state, at))
                    todo.append((gap[state], at))
                    if symbols[at] == CLOSE:
                        break
                    at = ends[at]
        return out

    def candidates(self, tree: ast.AST) -> dict[int, set[int]]:
        """By id() of a node: patterns that it may match, if there are any."""
        flat = Flat(tree, self.numbers)
        return {id(node): found for node, at in flat.nodes if (found := self.found(flat, at))}
