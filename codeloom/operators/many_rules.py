"""Many text rules over many files at the cost of few: an automaton finds the places of literals that a match must hold, in one
pass over a file, and only the lines that hold a rule's literal are searched with its pattern."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

HITS = "rule_id string, severity string, file_id string, line_no int, hit string"
#: Characters outside ASCII that an ASCII letter matches if case is ignored
_FOLDED = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})
TOGETHER = 20_000


def folded(text: str) -> str:
    return text.translate(_FOLDED).lower()


def literal_of(pattern: str) -> str:
    """The longest text that every match holds, folded; empty if none is certain. Alternatives, options and classes break it; what
    must occur at least once counts."""
    best, run = "", ""

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(parsed) -> None:
        nonlocal run
        for op, arg in parsed:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])  # a group is as good as what is in it
                continue
            if op is sre.AT:
                continue
            end()
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                end()

    try:
        walk(_parser.parse(pattern))
    except RecursionError:
        return ""
    end()
    return folded(best)


class Matcher:
    """Rules: dictionaries with id, pattern (classes and word ends are ASCII, as in line rules) and, if any, severity and excludes
    (texts that a line must not hold)."""

    def __init__(self, rules: list[dict]):
        self.rules = [(r["id"], r.get("severity", "medium"), re.compile(r["pattern"], re.ASCII), tuple(r.get("excludes", ()))) for r in rules]
        by_literal: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            by_literal.setdefault(literal_of(r["pattern"]), []).append(k)
        #: Rules without a literal look at every line
        self.always = by_literal.pop("", [])
        self.automaton = ahocorasick.Automaton() if by_literal else None
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, numbers)
        if self.automaton is not None:
            self.automaton.make_automaton()

    def hits(self, code: str) -> Iterator[tuple[str, str, int, str]]:
        """rule_id, severity, line_no, first match, by line and rule."""
        lines = code.split("\n")
        wanted: set[tuple[int, int]] = {(n, k) for n in range(len(lines)) for k in self.always}
        if self.automaton is not None:
            low = [folded(line) for line in lines]
            starts, at = [], 0
            for line in low:
                starts.append(at)
                at += len(line) + 1
            for end, numbers in self.automaton.iter("\n".join(low)):
                n = bisect_right(starts, end) - 1
                wanted.update((n, k) for k in numbers)
        for n, k in sorted(wanted):
            rule, severity, pattern, excludes = self.rules[k]
            if (m := pattern.search(lines[n])) and not any(x in lines[n] for x in excludes):
                yield rule, severity, n + 1, m[0]


def many_hits(files: DataFrame, rules: list[dict]) -> DataFrame:
    """HITS of files (file_id, code): for each rule and line its first match. Null code has none. The automaton is built once a
    task; its size follows the rules, which are the user's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, rows = Matcher(rules), []
        for batch in batches:
            for file_id, code in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = code.as_py()
                rows += [(rule, severity, file_id, n, hit) for rule, severity, n, hit in matcher.hits(text)] if text is not None else []
                if len(rows) >= TOGETHER:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.select("file_id", "code").mapInArrow(run, HITS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in HITS.split(", ")])
