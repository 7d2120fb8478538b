"""Rewriting of source text. A file's lines stay together in one array, so nothing is shuffled; the input is never changed in place."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..detect.engine import parse
from ..detect.source import FUNCTION

# Pattern of a line and what takes its place.
FIXES = {
    "bare_except": (r"^(\s*)except\s*:\s*\z", "$1except Exception:"),
    "debug_flag": (r"^(\s*)(DEBUG|debug)\s*=\s*True\s*\z", "$1$2 = False"),
    "trailing_blank": (r"[ \t]+\z", ""),
}


def fix_lines(files: DataFrame, kinds: tuple[str, ...] = tuple(FIXES)) -> DataFrame:
    """file_id, code (rewritten), n_changed (lines). Null code stays null with n_changed 0."""
    before = F.split("code", "\n", -1)

    def fixed(line):
        for kind in kinds:
            line = F.regexp_replace(line, *FIXES[kind])
        return line

    rows = files.select("file_id", before.alias("before")).withColumn("after", F.transform("before", fixed))
    changed = F.size(F.filter(F.zip_with("before", "after", lambda x, y: x != y), lambda x: x))
    return rows.select("file_id", F.array_join("after", "\n").alias("code"), F.when(F.col("before").isNull(), 0).otherwise(changed).cast("long").alias("n_changed"))


def ascii_only(files: DataFrame) -> DataFrame:
    """file_id, code without code points over 0x7F, n_removed."""
    clean = F.regexp_replace("code", "[^\\x00-\\x7F]", "")
    return files.select("file_id", clean.alias("code"), (F.length("code") - F.length(clean)).cast("long").alias("n_removed"))


# Signs and what is written for them.
SIGNS = {
    "\U0001f50d": "[SEARCH]", "\u26a0\ufe0f": "[WARN]", "\u26a0": "[WARN]", "\u2705": "[OK]", "\u274c": "[FAIL]", "\u2714": "[OK]", "\u2716": "[FAIL]",
    "\U0001f4a1": "[INFO]", "\U0001f527": "[FIX]", "\U0001f4cb": "[LIST]", "\U0001f3af": "[TARGET]", "\U0001f680": "[LAUNCH]", "\u2b50": "[STAR]",
    "\U0001f4c8": "[CHART]", "\U0001f440": "[LOOK]", "\u2728": "[SPARK]", "\U0001f6e0\ufe0f": "[TOOL]", "\U0001f6e0": "[TOOL]", "\U0001f4dd": "[NOTE]",
    "\u2139\ufe0f": "[INFO]", "\u2139": "[INFO]", "\U0001f4af": "[100]", "\u2764\ufe0f": "[HEART]", "\u2764": "[HEART]", "\U0001f4a5": "[BOOM]",
    "\U0001f525": "[FIRE]", "\U0001f3c6": "[TROPHY]", "\U0001f4e6": "[PKG]",
}
# Files opened without an encoding, and how.
OPENED = (
    (r'open\(([^,)]+),\s*"w"\s*\)', 'open($1, "w", encoding="utf-8")'),
    (r"open\(([^,)]+),\s*'w'\s*\)", "open($1, 'w', encoding='utf-8')"),
    (r'open\(([^,)]+),\s*"r"\s*\)', 'open($1, "r", encoding="utf-8", errors="replace")'),
    (r"open\(([^,)]+),\s*'r'\s*\)", "open($1, 'r', encoding='utf-8', errors='replace')"),
)


def plain_signs(text: Column, signs: dict[str, str] = SIGNS) -> Column:
    """Signs as words, longer ones first, then only ASCII."""
    for sign in sorted(signs, key=len, reverse=True):
        text = F.replace(text, F.lit(sign), F.lit(signs[sign]))
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def with_encoding(text: Column) -> Column:
    """open() with a mode alone gets an encoding."""
    for pattern, by in OPENED:
        text = F.regexp_replace(text, pattern, by)
    return text


def apply_replacements(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """file_id, code, n_applied: of fixes (file_id, line_number, original, replacement), those whose original still is the whole
    line, the first one of a line by its replacement. Lines stay in one array; a file without fixes is as it was."""
    own = fixes.groupBy("file_id", "line_number").agg(F.sort_array(F.collect_set(F.struct("original", "replacement"))).alias("f"))
    by_file = own.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("line_number", "f"))).alias("fixes"))
    lines = files.join(by_file, "file_id", "left").select("file_id", "fixes", F.split("code", "\n", -1).alias("before"))
    fix = lambda x, i: F.get(F.filter(F.try_element_at("fixes", (i + 1).cast("int")), lambda f: f["original"] == x), F.lit(0))["replacement"]
    lines = lines.withColumn("after", F.transform("before", lambda x, i: F.coalesce(fix(x, i), x)))
    applied = F.size(F.filter(F.transform("before", lambda x, i: fix(x, i).isNotNull()), lambda x: x))
    return lines.select("file_id", F.array_join("after", "\n").alias("code"), F.when(F.col("fixes").isNull(), 0).otherwise(applied).cast("long").alias("n_applied"))


def _undocumented(code: str | None) -> list[ast.AST]:
    try:
        nodes = parse("", None, code or "").of(*FUNCTION, ast.ClassDef)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [n for n in nodes if not n.name.startswith("_") and not isinstance(getattr(getattr(n.body[0], "value", None), "value", None), str)]


def missing_docstrings(files: DataFrame) -> DataFrame:
    """file_id, line_number, kind (class or function), name of what is public and has no docstring. Files that do not parse have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, n.lineno, "class" if isinstance(n, ast.ClassDef) else "function", n.name) for f, c in zip(batch.column(0).to_pylist(), batch.column(1)) for n in _undocumented(c.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file_id", "line_number", "kind", "name"])

    return files.select("file_id", "code").mapInArrow(run, "file_id string, line_number int, kind string, name string")


def documented(code: str) -> tuple[str, int]:
    """The code with a docstring of three lines before the body of everything public without one, and how many. A body on the
    line of its header is left as it is."""
    lines, found = code.split("\n"), _undocumented(code)
    at = sorted(((n.body[0].lineno - 1, n) for n in found if n.body[0].lineno > n.lineno), key=lambda x: -x[0])
    for k, n in at:
        indent = lines[k][: len(lines[k]) - len(lines[k].lstrip())]
        kind = "class" if isinstance(n, ast.ClassDef) else "function"
        lines[k:k] = [f'{indent}"""', f"{indent}{n.name.replace('_', ' ').strip().capitalize()} {kind}.", f'{indent}"""']
    return "\n".join(lines), len(at)


def insert_docstrings(files: DataFrame) -> DataFrame:
    """file_id, code, n_inserted; null code stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, 0) if c.as_py() is None else documented(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file_id", "code", "n_inserted"])

    return files.select("file_id", "code").mapInArrow(run, "file_id string, code string, n_inserted long")
