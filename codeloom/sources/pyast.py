"""Python source as a table of syntax-tree nodes, each file parsed once."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..detect.engine import Known, parse
from ..detect.source import BLOCK, FUNCTION, NESTED, children

#: nest: ancestors within the function that make a branch harder to follow; block_nest: those that open a nested block, anywhere
NODE = "file_id string, node_id int, parent_id int, depth int, kind string, name string, lineno int, end_lineno int, func_id int, class_id int, nest int, block_nest int, n_args int, has_else boolean, has_doc boolean, n_values int, parse_error string"
_BODIES = (*FUNCTION, ast.ClassDef, ast.Module)
_COLUMNS = [c.split() for c in NODE.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t] for _, t in _COLUMNS]
#: Nodes that leave a task together
TOGETHER = 50_000


def _rows(code: str) -> list[tuple]:
    """Without file_id."""
    try:
        root = parse("", None, code).tree
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(*[None] * (len(_COLUMNS) - 2), str(e))]
    out, queue, number = [], [(root, None, 0, None, None, 0, 0)], 0
    while number < len(queue):  # breadth first
        node, parent, depth, func, cls, nest, block = queue[number]
        is_func = isinstance(node, FUNCTION)
        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
        args = node.args if is_func else None
        out.append((
            number, parent, depth, type(node).__name__, name if isinstance(name, str) else None, getattr(node, "lineno", None), getattr(node, "end_lineno", None), func, cls, nest, block,
            sum(map(len, (args.posonlyargs, args.args, args.kwonlyargs))) if args else None, bool(node.orelse) if isinstance(node, (ast.If, ast.For, ast.While)) else None,
            ast.get_docstring(node) is not None if isinstance(node, _BODIES) else None, len(node.values) if isinstance(node, ast.BoolOp) else None, None,
        ))
        below = (number if is_func else func, number if isinstance(node, ast.ClassDef) else cls, 0 if is_func else nest + isinstance(node, NESTED), block + isinstance(node, BLOCK))
        queue += [(child, number, depth + 1, *below) for child in children(node)]
        number += 1
    return out


def nodes(files: DataFrame) -> DataFrame:
    """One row per node of every file (file_id, code), node_id in breadth-first order; a file that does not parse is one row with
    parse_error. Null code is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        known = Known()
        for batch in batches:
            for f, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = c.as_py() or ""
                own = known.get(code)
                if own is None:
                    own = _rows(code)
                    known.keep(code, own, len(own))
                rows += [(f, *row) for row in own]
                if len(rows) >= TOGETHER:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.select("file_id", "code").mapInArrow(run, NODE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[c for c, _ in _COLUMNS])
