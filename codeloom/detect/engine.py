"""Runs detectors over a table of files: one pass, one parse per file, facts out. Everything after it is relational."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import architecture, complexity, edge_cases, flows, readability, security, style, symbols, test_code, values
from .source import HERE, STEM, Fact, Source, failure, is_test, stem_of

FACTS = "file_id string, seq long, analyzer string, kind string, name string, severity string, title string, line_number int, scope string, value double, detail string"
DETECTORS: dict[str, Callable[[Source], Iterator[Fact]]] = {m.NAME: m.detect for m in (complexity, security, style, architecture, edge_cases, test_code, readability)}
#: Detectors that run if they are named: of names and flows, of which operators over many files make sense, and of paths
ON_DEMAND: dict[str, Callable[[Source], Iterator[Fact]]] = {m.NAME: m.detect for m in (symbols, flows, values)} | {"test_shapes": test_code.shapes}
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.float64(), pa.string()]
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
#: Facts that leave a task together
TOGETHER = 20_000
#: What a task keeps of equal codes: rows, and 64 characters of code count as one
KEPT = 100_000


class Known:
    """Rows by code, for the codes met last. Copies of a file (vendored, generated, empty ones) are parsed once in a task."""

    def __init__(self, most: int = KEPT):
        self.most, self.size, self.rows = most, 0, {}

    def get(self, code: str):
        """None if the code is not here."""
        found = self.rows.pop(code, None)
        if found is not None:
            self.rows[code] = found  # the last one again
        return found and found[0]

    def keep(self, code: str, rows, n: int) -> None:
        size = n + len(code) // 64 + 1
        if size > self.most:
            return
        self.size += size - self.rows.pop(code, (None, 0))[1]
        self.rows[code] = rows, size
        while self.size > self.most:
            self.size -= self.rows.pop(next(iter(self.rows)))[1]


class _Noted(Source):
    """Notes whether a detector looks at more than the code."""

    noted = False

    def __getattribute__(self, name):
        if name in ("path", "file_id"):
            self.noted = True
        return super().__getattribute__(name)


def parse(file_id: str, path: str | None, code: str) -> Source:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of invalid escapes in the code
        return _Noted(file_id, path or file_id, code, ast.parse(code))


def _unparsed(file_id: str, path: str | None, code: str, e: Exception, detectors: Iterable[tuple[str, Callable]]) -> Iterator[Fact]:
    yield Fact("parser", "parse_error", type(e).__name__, title=str(e)[:200], line_number=getattr(e, "lineno", None))
    if isinstance(e, (RecursionError, MemoryError)) and any(name == security.NAME for name, _ in detectors):
        yield from security.in_text(Source(file_id, path or file_id, code, ast.Module([], [])))


def _named(facts: Iterable[Fact], path: str) -> Iterator[Fact]:
    name = path.rpartition("/")[2]
    for fact in facts:
        if fact.title and HERE in fact.title:
            fact = replace(fact, title=fact.title.replace(HERE, name))
        yield replace(fact, scope=stem_of(name)) if fact.scope == STEM else fact


def facts_of(file_id: str, path: str | None, code: str | None, detectors: Iterable[tuple[str, Callable]], known: Known | None = None) -> Iterator[Fact]:
    """A file that does not parse has one fact, of kind "parse_error"; one that is well-formed but too deep for the parser has what
    the text alone shows besides. A part of a detector that fails has one fact, of kind "failure", and all else goes on. Null
    and empty code have no facts. known: what the same detectors found in other files; of equal code, the facts of detectors that
    looked at the code alone (or, by their `view` of the path, saw the same), and did not fail, are taken from there."""
    if not code:
        return
    old = (known and known.get(code)) or {}
    if None in old:  # does not parse
        yield from old[None]
        return
    new: dict[tuple | None, list[Fact]] = {}
    source = None
    for name, detect in detectors:
        if name == test_code.NAME and path is not None and not is_test(path):
            continue
        view = getattr(detect, "view", None)
        key = (name, view and view(path or file_id))
        if key in old:
            yield from _named(old[key], path or file_id)
            continue
        if source is None:
            try:
                source = parse(file_id, path, code)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                new = {None: list(_unparsed(file_id, path, code, e, detectors))}
                yield from new[None]
                break
        source.noted, found = False, []
        try:
            for fact in detect(source):
                found.append(fact)
                yield from _named((fact,), path or file_id)
        except Exception as e:  # as data: one detector must not cost the others
            yield failure(name, e)
            continue
        if view or not source.noted:
            new[key] = found
    if new and known is not None:
        known.keep(code, {**old, **new}, sum(map(len, {**old, **new}.values())))


def facts(files: DataFrame, *names: str, extra: dict[str, Callable[[Source], Iterator[Fact]]] | None = None) -> DataFrame:
    """FACTS of `files` (file_id, code, and path where there is one) by the named detectors, all of DETECTORS if none is named,
    and by `extra` ones. seq numbers a file's facts from 0. Test quality looks at test files alone where there is a path."""
    chosen = [(n, d) for n, d in DETECTORS.items() if n in names or not (names or extra)] + [(n, d) for n, d in ON_DEMAND.items() if n in names] + list((extra or {}).items())
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        known = Known()
        for batch in batches:
            for file_id, at, code in zip(*(batch.column(k) for k in range(3))):
                file_id, at = file_id.as_py(), at.as_py()
                for seq, f in enumerate(facts_of(file_id, at, code.as_py(), chosen, known)):
                    rows.append((file_id, seq, f.analyzer, f.kind, f.name, f.severity, f.title, f.line_number, f.scope, f.value, f.detail))
                if len(rows) >= TOGETHER:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.select("file_id", path.alias("path"), "code").mapInArrow(run, FACTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def issues(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'issue'").select("file_id", "seq", "analyzer", "severity", F.col("name").alias("rule_id"), "title", "line_number", "detail")


def file_measures(found: DataFrame, *names: str) -> DataFrame:
    """One row per file with the named measures of whole files as columns."""
    whole = found.filter("kind = 'measure' and scope is null and name in ({})".format(", ".join(f"'{n}'" for n in names)))
    return whole.groupBy("file_id").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def scoped_measures(found: DataFrame, *names: str) -> DataFrame:
    """One row per measured function, class or test (by file, name and line)."""
    part = found.filter("kind = 'measure' and scope is not null and name in ({})".format(", ".join(f"'{n}'" for n in names)))
    return part.groupBy("file_id", "scope", "line_number").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
