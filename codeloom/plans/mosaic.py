"""Code made from table rows, and the SQL that knows what is to be found in it. A file is put together of pieces; a row of
`part` has a piece if its key leaves the piece's rest. What each piece holds is stated by hand, beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread, table


@dataclass(frozen=True)
class Piece:
    """found: (rule, severity, title, line within the piece, from 1; 0: no line). values: by measure, what the piece adds."""

    modulus: int
    rest: int
    code: str
    found: tuple[tuple[str, str, str, int], ...] = ()
    values: tuple[tuple[str, float], ...] = ()

    @property
    def here(self) -> str:
        return f"p_partkey % {self.modulus} = {self.rest}"


def files(spark, d: str, pieces: list[Piece], prefix: str = "src/m") -> DataFrame:
    code = F.concat(*(F.when(F.expr(p.here), F.lit(p.code)).otherwise(F.lit("")) for p in pieces))
    key = F.col("p_partkey").cast("string")
    return spread(table(spark, d, "part").select("p_partkey")).select(key.alias("file_id"), F.concat(F.lit(prefix), key, F.lit(".py")).alias("path"), code.alias("code"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def found_sql(pieces: list[Piece], keep=lambda rule: True) -> str:
    """file_id, rule_id, severity, title, line_number of everything the pieces hold. {} in a title is the file's name."""
    out, before = [], ["0"]
    for p in pieces:
        base = " + ".join(before)
        for rule, severity, title, line in p.found:
            if keep(rule):
                at = f"CAST({base} + {line} AS INTEGER)" if line else "CAST(NULL AS INTEGER)"
                name = " || 'm' || CAST(p_partkey AS VARCHAR) || '.py' || ".join(map(_text, title.split("{}")))
                out.append(f"SELECT CAST(p_partkey AS VARCHAR) AS file_id, {_text(rule)} AS rule_id, {_text(severity)} AS severity, {name} AS title, {at} AS line_number FROM part WHERE {p.here}")
        before.append(f"CASE WHEN {p.here} THEN {p.code.count(chr(10))} ELSE 0 END")
    return " UNION ALL ".join(out)


def total(pieces: list[Piece], name: str, how: str = "+") -> str:
    """A measure of a whole file: the sum (or, with how="max", the greatest) of its pieces' values. An expression over part."""
    terms = [f"CASE WHEN {p.here} THEN {v} ELSE 0 END" for p in pieces for n, v in p.values if n == name]
    if how == "max":
        return f"greatest({', '.join([*terms, '0'])})"
    return f"({' + '.join([*terms, '0'])})"


def line_total(pieces: list[Piece]) -> str:
    """Lines of a file; the last one is empty."""
    return "(" + " + ".join(f"CASE WHEN {p.here} THEN {p.code.count(chr(10))} ELSE 0 END" for p in pieces) + " + 1)"
