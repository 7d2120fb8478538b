"""Source trees as a Spark data source, for reading and for writing.

    register(spark)
    spark.read.format("codeloom").load("/shared/project").filter("path like '/shared/project/src/%' and size_bytes < 10000")

The driver lists directories, level by level, only until there are enough to deal out; the tasks list what is below, leave out
what git's patterns ignore, and read the files. Filters on path, name, suffix and size are decided by the tasks before a file is
opened, and directories that no wanted path is in are not listed.

Written rows become one file a task, first in a folder of the attempt. Only the driver's commit, once all tasks have ended,
moves them to where a reader looks; a failed task or job leaves nothing."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

from .trees import FILE, IGNORED, LARGEST_KB, ignores

#: Directories from which on the driver lists no further
ENOUGH = 64
#: Columns that a file's entry gives before it is opened
KNOWN = ("file_id", "path", "name", "stem", "suffix", "size_bytes")


@dataclass
class Share(InputPartition):
    """Directories to list with all below them, and single files."""

    directories: tuple[str, ...]
    files: tuple[str, ...]


def entry(path: str, size: int | None) -> dict:
    name = path.rpartition("/")[2]
    stem, dot, suffix = name.rpartition(".")
    plain = not dot or not stem
    return {"file_id": path, "path": path, "name": name, "stem": name if plain else stem, "suffix": "" if plain else f".{suffix}", "size_bytes": size}


def holds(f: Filter, values: dict) -> bool:
    value = values[f.attribute[0]]
    if value is None:
        return False
    match f:
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case StringEndsWith():
            return value.endswith(f.value)
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
    raise TypeError(type(f))


def may_hold(f: Filter, directory: str) -> bool:
    """Whether a path below a directory can pass."""
    if f.attribute[0] not in ("path", "file_id"):
        return True
    below = directory.rstrip("/") + "/"
    match f:
        case StringStartsWith():
            return below.startswith(f.value) or f.value.startswith(below)
        case EqualTo():
            return isinstance(f.value, str) and f.value.startswith(below)
        case In():
            return any(isinstance(v, str) and v.startswith(below) for v in f.value)
    return True


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        ignored = options.get("ignore")
        self.ignored = tuple(IGNORED if ignored is None else filter(None, ignored.split(",")))
        self.suffixes = tuple(filter(None, options.get("suffixes", ".py").split(",")))
        self.largest = float(options.get("largestKb", LARGEST_KB)) * 1024
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in (EqualTo, In, StringStartsWith, StringEndsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute[0] in KNOWN:
                self.filters.append(f)
            else:
                yield f

    def _scan(self, directory: str) -> tuple[list[str], list[str]]:
        """Directories and files right below that are not left out, sorted. Links are not followed."""
        skip = ignores(self.ignored)
        directories, files = [], []
        with os.scandir(directory) as found:
            for e in sorted(found, key=lambda e: e.name):
                inner = os.path.relpath(e.path, self.root)
                if e.is_dir(follow_symlinks=False):
                    # what lies below an ignored directory is ignored, so a name in it tells
                    if not skip(f"{inner}/x") and all(may_hold(f, e.path) for f in self.filters):
                        directories.append(e.path)
                elif e.is_file() and e.name.endswith(self.suffixes) and not skip(inner):
                    files.append(e.path)
        return directories, files

    def partitions(self) -> list[Share]:
        if os.path.isfile(self.root):
            return [Share((), (self.root,))]
        level, files = [self.root], []
        while level and len(level) < ENOUGH:
            below = []
            for directory in level:
                directories, own = self._scan(directory)
                below += directories
                files += own
            level = below
        shares = [Share((d,), ()) for d in level]
        shares += [Share((), tuple(files[k : k + ENOUGH])) for k in range(0, len(files), ENOUGH)]
        return shares or [Share((), ())]

    def read(self, share: Share) -> Iterator[tuple]:
        stack = list(reversed(share.directories))
        yield from self._files(share.files)
        while stack:
            try:
                directories, files = self._scan(stack.pop())
            except OSError:
                continue  # gone meanwhile, or not ours to read
            yield from self._files(files)
            stack += reversed(directories)

    def _files(self, paths: tuple[str, ...] | list[str]) -> Iterator[tuple]:
        for path in paths:
            try:
                size = os.stat(path).st_size
            except OSError:
                continue
            values = entry(path, size)
            if size > self.largest or not all(holds(f, values) for f in self.filters):
                continue
            try:
                with open(path, "rb") as f:
                    code = f.read().decode().replace("\r\n", "\n").replace("\r", "\n")
            except (OSError, UnicodeDecodeError):
                code = None  # as data
            yield (*values.values(), code)


@dataclass
class Written(WriterCommitMessage):
    draft: str | None
    rows: int


class LinesWriter(DataSourceWriter):
    """Rows as JSON, a line each."""

    def __init__(self, options: dict, schema, overwrite: bool):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.root, self.names, self.overwrite = options["path"].removeprefix("file://").rstrip("/"), schema.names, overwrite
        self.drafts = f"{self.root}/_drafts/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.drafts, exist_ok=True)
        draft, rows = f"{self.drafts}/part-{uuid.uuid4().hex}.jsonl", 0
        with open(draft, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(json.dumps(dict(zip(self.names, row)), default=str) + "\n")
                rows += 1
        return Written(draft, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of other attempts are in no message, and go with the drafts."""
        old = [e.path for e in os.scandir(self.root) if e.is_file()] if self.overwrite and os.path.isdir(self.root) else []
        for m in messages:
            if m is not None and m.rows:
                os.replace(m.draft, f"{self.root}/{os.path.basename(m.draft)}")
        for path in old:
            os.remove(path)
        self._clear()
        with open(f"{self.root}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.drafts, ignore_errors=True)
        try:
            os.rmdir(f"{self.root}/_drafts")
        except OSError:
            pass  # another job writes


class TreeSource(DataSource):
    """Options of reading: path, suffixes (".py", by commas), ignore (patterns, by commas), largestKb. Of writing: path."""

    @classmethod
    def name(cls) -> str:
        return "codeloom"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, which filters are then pushed to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
