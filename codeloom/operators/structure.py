"""Functions and classes of source files: one Arrow pass that folds each file in its task and emits a row per block."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detect import architecture, complexity
from ..detect.engine import Known, parse
from ..detect.source import FUNCTION, argument_names, walk

FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
#: A row per function or class (kind); what a kind does not have is null
BLOCKS = "file_id string, kind string, name string, line_number int, n_lines int, has_doc boolean, arguments array<string>, cyclomatic long, cognitive long, simple long, npath double, nesting long, n_args long, n_ifs long, missing_else long, methods long, wmc long, cohesion_groups long, responses long"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), *[pa.int64()] * 3, pa.float64(), *[pa.int64()] * 8]


def _row(node: ast.AST) -> tuple:
    head = (type(node).__name__, node.name, node.lineno, node.end_lineno - node.lineno + 1, ast.get_docstring(node) is not None)
    if isinstance(node, ast.ClassDef):
        return (*head, None, complexity.cyclomatic(node), *[None] * 7, len(architecture.methods(node)), architecture.weight(node), architecture.cohesion_groups(node), architecture.responses(node))
    ifs = [n for n in walk(node) if isinstance(n, ast.If)]
    a = node.args
    positional = [x.arg for x in a.posonlyargs]
    return (
        *head, positional + argument_names(node), complexity.cyclomatic(node), complexity.cognitive(node), complexity.simple(node), float(complexity.npath(node.body)), complexity.nesting(node),
        len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs), len(ifs), sum(not n.orelse for n in ifs), *[None] * 4,
    )


def blocks(files: DataFrame) -> DataFrame:
    """BLOCKS of `files` (file_id, code). Files that do not parse, null and empty code have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            rows = []
            for file_id, code in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = code.as_py() or ""
                own = known.get(code)
                if own is None:
                    try:
                        own = [_row(n) for n in parse("", None, code).of(*FUNCTION, ast.ClassDef)]
                    except (SyntaxError, ValueError, RecursionError, MemoryError):
                        own = []
                    known.keep(code, own, len(own))
                rows += [(file_id, *row) for row in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return files.select("file_id", "code").mapInArrow(run, BLOCKS)


def functions(files: DataFrame) -> DataFrame:
    return blocks(files).filter(F.col("kind").isin(*FUNCTIONS)).withColumnRenamed("name", "func")


def classes(files: DataFrame) -> DataFrame:
    return blocks(files).filter("kind = 'ClassDef'").withColumnRenamed("name", "class")


def docstring_coverage(files: DataFrame) -> DataFrame:
    """Documented share (percent) of functions that are not async, and classes, per file that parses; 100 without any."""
    own = blocks(files).filter(F.col("kind").isin("FunctionDef", "ClassDef"))
    share = own.groupBy("file_id").agg((100.0 * F.avg(F.col("has_doc").cast("double"))).alias("pct"))
    return files.select("file_id").join(share, "file_id", "left").select("file_id", F.coalesce("pct", F.lit(100.0)).alias("pct"))


def histogram(files: DataFrame) -> DataFrame:
    """kind, n: nodes of each kind. A task adds up its files before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for code in batch.column(0):
                try:
                    counts.update(type(n).__name__ for n in parse("", None, code.as_py() or "").nodes)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
        if counts:
            yield pa.RecordBatch.from_pydict({"kind": list(counts), "n": list(counts.values())})

    return files.select("code").mapInArrow(run, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n"))


def similar_names(names: DataFrame, most: int = 5) -> DataFrame:
    """file_id, a, b: pairs of distinct names over 3 letters, at most a third of the shorter one apart (Levenshtein), the first
    `most` of a file in order. The sets of one file meet each other; lengths are compared before the distance."""
    from pyspark.sql import Window

    limit = F.floor(F.least(F.length("a"), F.length("b")) / 3).cast("int")
    own = names.filter(F.length("name") > 3).distinct()
    pairs = own.select("file_id", F.col("name").alias("a")).join(own.select("file_id", F.col("name").alias("b")), "file_id").filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= limit) & (F.levenshtein("a", "b") <= limit))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("a", "b"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select("file_id", "a", "b")
