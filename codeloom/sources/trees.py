"""Source files from where a user has them: a directory, a file, or a repository that was checked out."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FILE = "file_id string, path string, name string, stem string, suffix string, size_bytes long, code string"
# What a tree scan takes and leaves out by default.
PATTERNS, LARGEST_KB = ("**/*.py",), 1000
IGNORED = (
    "**/__pycache__/**", "**/venv/**", "**/.venv/**", "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**",
    "**/*.egg-info/**", "**/.pytest_cache/**", "**/.mypy_cache/**", "**/.ruff_cache/**",
)


class SourceError(ValueError):
    """A source that cannot be read."""


def _regex(pattern: str) -> str:
    """Of a pattern without its leading ! and trailing /. Without another slash it may match at any depth."""
    anchored = "/" in pattern
    out, at = ("" if anchored else "(?:.*/)?"), 0
    pattern = pattern.removeprefix("/")
    while at < len(pattern):
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out, at = out + "/.+", at + 3
        elif pattern[at] == "*":
            run = re.match(r"\*+", pattern[at:])[0]
            out, at = out + "[^/]*", at + len(run)
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        elif pattern[at] == "[" and (end := pattern.find("]", at + 2)) > 0:
            inner = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif pattern[at] == "\\" and at + 1 < len(pattern):
            out, at = out + re.escape(pattern[at + 1]), at + 2
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return out


def ignores(patterns) -> "callable":
    """Whether a relative path is ignored, by patterns as git has them: the last one that matches the path or a directory above
    it decides, ! takes back, a trailing / is for directories only; what lies below an ignored directory is ignored."""
    rules = []
    for p in patterns:
        p = p.rstrip()
        if p and not p.startswith("#"):
            wanted, body = not p.startswith("!"), p.removeprefix("!")
            rules.append((wanted, body.endswith("/"), re.compile(_regex(body.rstrip("/")) + r"\Z", re.S)))

    def one(path: str, is_dir: bool) -> bool:
        return next((wanted for wanted, dirs, r in reversed(rules) if (is_dir or not dirs) and r.match(path)), False)

    def test(path: str) -> bool:
        parts = path.split("/")
        return any(one("/".join(parts[:k]), True) for k in range(1, len(parts))) or one(path, False)

    return test


def listed(root: str, patterns=PATTERNS, ignore=IGNORED, largest_kb: float = LARGEST_KB) -> list[str]:
    """Paths of the files under a directory, sorted, each once. Names that begin with `_` or `.` are listed like others."""
    top, out = Path(root), set()
    skip = ignores(ignore)
    for pattern in patterns:
        for p in top.rglob(pattern.removeprefix("**/")):
            if p.is_file() and not skip(p.relative_to(top).as_posix()) and p.stat().st_size / 1024 <= largest_kb:
                out.add(str(p))
    return sorted(out)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FILE rows of the paths, read by the tasks. Files that cannot be read or are no UTF-8 have null code; line ends become \\n."""

    def read(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                p, raw, code = Path(path), None, None
                try:
                    raw = p.read_bytes()
                    code = raw.decode().replace("\r\n", "\n").replace("\r", "\n")
                except (OSError, UnicodeDecodeError):
                    pass  # as data: code stays null
                rows.append((path, path, p.name, p.stem, p.suffix, None if raw is None else len(raw), code))
            yield pdf.__class__(rows, columns=[c.split()[0] for c in FILE.split(", ")]).astype({"size_bytes": "Int64"})

    # the listing is as long as a source tree; each task takes a share of it
    tasks = min(max(1, len(paths) // 64), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(read, FILE)


class SourceReader(ABC):
    """Prepares a source, gives its files, cleans up; a context manager."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def prepare(self) -> None:
        if not Path(self.path).exists():
            raise SourceError(f"not found: {self.path}")

    @abstractmethod
    def files(self) -> DataFrame: ...

    def cleanup(self) -> None:
        """Nothing is left behind by default."""

    def __enter__(self):
        self.prepare()
        return self

    def __exit__(self, *_) -> None:
        self.cleanup()


class Directory(SourceReader):
    def __init__(self, spark: SparkSession, path: str, patterns=PATTERNS, ignore=IGNORED, largest_kb: float = LARGEST_KB):
        super().__init__(spark, path)
        self.options, self.found = (patterns, ignore, largest_kb), None

    def prepare(self) -> None:
        super().prepare()
        if not Path(self.path).is_dir():
            raise SourceError(f"not a directory: {self.path}")

    def files(self) -> DataFrame:
        self.found = listed(self.path, *self.options) if self.found is None else self.found
        return read_files(self.spark, self.found)


class SingleFile(SourceReader):
    """One file, whatever its name and size."""

    def prepare(self) -> None:
        super().prepare()
        if not Path(self.path).is_file():
            raise SourceError(f"not a file: {self.path}")

    def files(self) -> DataFrame:
        return read_files(self.spark, [self.path])


class Checkout(Directory):
    """A repository by its address, at the path where it was checked out: nothing is fetched here."""

    def __init__(self, spark: SparkSession, url: str, path: str | None = None, **options):
        super().__init__(spark, path or "", **options)
        self.url = url

    def prepare(self) -> None:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)", self.url)
        if not m or "github.com" not in m[1].lower() or len([p for p in m[2].split("/") if p]) < 2:
            raise SourceError(f"not the address of a repository: {self.url}")
        super().prepare()


def source(spark: SparkSession, at: str, checkout: str | None = None, **options) -> SourceReader:
    """The reader for an address, a file or a directory."""
    if at.startswith(("http://", "https://")) and "github.com" in at.lower():
        return Checkout(spark, at, checkout, **options)
    if Path(at).is_file():
        return SingleFile(spark, at)
    if Path(at).is_dir():
        return Directory(spark, at, **options)
    raise SourceError(f"no file, directory or repository: {at}")


def git_info(path: str) -> dict[str, str | None]:
    """Branch, eight digits of the commit, and remote of a checked-out repository, read from its own files; nulls if it is none."""
    git, out = Path(path) / ".git", {"branch": None, "commit": None, "remote": None}
    try:
        head = (git / "HEAD").read_text().strip()
        ref = head.removeprefix("ref: ")
        if ref != head:
            out["branch"] = ref.removeprefix("refs/heads/")
            packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
            head = (git / ref).read_text().strip() if (git / ref).exists() else next((x.split()[0] for x in packed if x.endswith(f" {ref}")), "")
        out["commit"] = head[:8] or None
        m = re.search(r"\[remote [^\]]*\][^\[]*?url\s*=\s*(\S+)", (git / "config").read_text())
        out["remote"] = m[1] if m else None
    except OSError:
        pass
    return out
