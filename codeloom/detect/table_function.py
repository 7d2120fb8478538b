"""Detectors as a table function of SQL.

    register(spark)
    SELECT f.path, i.name, i.line_number FROM files f, LATERAL code_facts(f.code, f.path, detectors => 'security, style', columns => 'kind, name, line_number') i

The detectors and columns must be known when the query is analyzed; a wrong name is an error of the query, not of its tasks. Only
the columns that are named leave the Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from . import engine

NAME = "code_facts"
#: All columns of a fact but the file's. A worker that analyzes a query has no session to parse types
_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType()}
COLUMNS = {c.split()[0]: _KINDS[c.split()[1]] for c in engine.FACTS.split(", ")[1:]}


@dataclass
class Chosen(AnalyzeResult):
    detectors: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()


def _listed(argument: AnalyzeArgument | None, known: list[str], what: str) -> tuple[str, ...]:
    """The names in a constant text; all known ones if it is left out or null."""
    if argument is None:
        return tuple(known)
    if not argument.isConstantExpression:
        raise ValueError(f"{what} must be a constant")
    names = [n.strip() for n in (argument.value or "").split(",") if n.strip()] or known
    if wrong := [n for n in names if n not in known]:
        raise ValueError(f"unknown {what}: {', '.join(wrong)}")
    return tuple(names)


class CodeFacts:
    def __init__(self, chosen: Chosen):
        known = engine.DETECTORS | engine.ON_DEMAND
        self.detectors = [(n, known[n]) for n in chosen.detectors]
        self.columns = chosen.columns

    @staticmethod
    def analyze(code: AnalyzeArgument, path: AnalyzeArgument | None = None, detectors: AnalyzeArgument | None = None, columns: AnalyzeArgument | None = None) -> Chosen:
        names = _listed(detectors, [*engine.DETECTORS, *(engine.ON_DEMAND if detectors is not None and detectors.value else ())], "detectors")
        kept = _listed(columns, list(COLUMNS), "columns")
        schema = StructType()
        for c in kept:
            schema = schema.add(c, COLUMNS[c])
        return Chosen(schema=schema, detectors=names, columns=kept)

    def eval(self, code: str, path: str | None = None, detectors: str | None = None, columns: str | None = None) -> Iterator[tuple]:
        for seq, f in enumerate(engine.facts_of("", path, code, self.detectors)):
            yield tuple(seq if c == "seq" else getattr(f, c) for c in self.columns)


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, udtf(CodeFacts))
