"""Queries on values along paths and on structure, on pieces of code whose findings are stated beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..detect import engine
from . import mosaic
from .detectors import issue_query
from .mosaic import Piece, found_sql, total
from .queries import query

# fmt: off
PATHS = [
    Piece(1, 0, 'import os\n'),
    Piece(2, 0, 'def split(total, n):\n    if n:\n        return total / n\n    else:\n        return total / n\n', (('PATH_DIVISION', 'high', 'Division by Zero Risk: n', 5),), (('structured', 1),)),
    Piece(2, 1, 'def share(rows):\n    count = len(rows)\n    while count > 0:\n        rows = rows / count\n        count -= 1\n    return rows / count\n', (('PATH_DIVISION', 'high', 'Division by Zero Risk: count', 6),), (('structured', 1),)),
    Piece(3, 0, 'def pick(row=None):\n    if row is None:\n        print(row.name)\n    return row.name\n', (('PATH_NONE', 'high', 'Use of None: row', 3), ('PATH_NONE', 'medium', 'Missing None Check: row', 4)), (('structured', 1),)),
    Piece(3, 1, 'def safe(row=None):\n    row = row or {}\n    return row["a"]\n'),
    Piece(5, 0, 'zero = 0\nbad = 1 / zero\nbig = 4000000000 * 4000000000\n', (('PATH_DIVISION', 'critical', 'Division by Zero: zero', 2), ('PATH_OVERFLOW', 'low', 'Numeric Overflow of 64 Bits', 3))),
    Piece(5, 1, 'def hunt(rows):\n    for row in rows:\n        for cell in row:\n            if cell:\n                break\n            use(cell)\n', (), (('structured', 3),)),
]
#: By piece: its function, cyclomatic complexity and essential complexity by reduction
FUNCTIONS = {1: ('split', 2, 1), 2: ('share', 2, 1), 3: ('pick', 2, 1), 4: ('safe', 2, 1), 6: ('hunt', 4, 3)}
# fmt: on

issue_query("paths_division", PATHS, "paths", "PATH_DIVISION")
issue_query("paths_none", PATHS, "paths", "PATH_NONE")
issue_query("paths_overflow", PATHS, "paths", "PATH_OVERFLOW")

_AT = [Piece(p.modulus, p.rest, p.code, ((FUNCTIONS[k][0], str(FUNCTIONS[k][1]), str(FUNCTIONS[k][2]), 1),) if k in FUNCTIONS else ()) for k, p in enumerate(PATHS)]


@query(f"""SELECT f.file_id, rule_id AS scope, line_number, CAST(title AS DOUBLE) AS reduced, greatest(1.0, CAST(severity AS DOUBLE) - s.structured + 1) AS formula
 FROM ({found_sql(_AT)}) f JOIN (SELECT CAST(p_partkey AS VARCHAR) AS file_id, {total(PATHS, 'structured')} AS structured FROM part) s USING (file_id)""")
def essential_by_reduction(spark, d):
    """Essential complexity by reduction of the control flow, beside the formula that is taken over the whole file."""
    found = engine.facts(mosaic.files(spark, d, PATHS), "paths", "complexity").filter("kind = 'measure' and name = 'essential'")
    value = lambda a: F.max(F.when(F.col("analyzer") == a, F.col("value")))
    return found.groupBy("file_id", "scope", "line_number").agg(value("paths").alias("reduced"), value("complexity").alias("formula"))
