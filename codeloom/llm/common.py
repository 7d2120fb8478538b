"""What the operators share: the shared folder, written intermediate tables, word splitting and hashing."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that end a word, for the two word definitions in use. Bytes over 0x7F always belong to a word,
#: so splitting UTF-8 bytes gives the same words as splitting code points.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(b for b in range(0x80) if not chr(b).isalnum())


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. Cuts the lineage: a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, shared_path(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As materialize() does."""
        self.tables += 1
        path = f"{self.path}/{self.tables:02d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Writes the run's result and deletes all other tables."""
        out = materialize(df, "result")
        self.drop()
        return out

    def drop(self) -> None:
        """Deletes the folder. Nothing that is still to run may read from it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one Arrow batch. Spark's default of 10,000 rows bounds no bytes: of long texts, a batch and its copies on both sides
#: of a Python worker are hundreds of megabytes.
BATCH_ROWS = 2_000


def in_batches(df: DataFrame) -> DataFrame:
    """df, for a scan of its texts in Python: sets the session to batches of BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def input_partitions(df: DataFrame) -> int:
    """Partitions of a scan: grows with the input and follows the cluster's settings."""
    return max(1, df._jdf.rdd().getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps between the tasks of a Python worker. All operators share the workers, so when another one
    takes over, the last one's goes and its memory returns to the system."""
    if owner not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _KEPT[owner] = {}
    return _KEPT[owner]


def ascii_lower(col: Column) -> Column:
    """A-Z only, so results do not depend on the locale's case rules."""
    return F.translate(col, UPPER, LOWER)


def _table(separators: bytes) -> bytes:
    """For bytes.translate: separators become a space, which bytes.split() then drops. It also splits at 0x09-0x0D, separators in both kinds."""
    out = bytearray(range(256))
    for u, low in zip(UPPER.encode(), LOWER.encode()):
        out[u] = low
    for b in separators:
        out[b] = 0x20
    return bytes(out)


TABLES = {"white": _table(WHITE), "alnum": _table(NOT_ALNUM)}


def words_of(text: str | None, kind: str = "white") -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8. kind: "white" splits at white space, "alnum" at every ASCII non-alphanumeric."""
    return (text or "").encode().translate(TABLES[kind]).split()


#: Random 64-bit values, the same in every process.
_RNG = np.random.Generator(np.random.PCG64(20_240_901))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("up", _ODD), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of raw bytes. Equal spans have equal hashes wherever they stand."""
    up, down = _powers(len(raw) + 1)
    run = np.empty(len(raw) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(text: str | None, kind: str = "white") -> np.ndarray:
    """64-bit hashes of the text's words in order. Equal words have equal hashes wherever they stand."""
    raw = np.frombuffer((text or "").encode().translate(TABLES[kind]), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(raw, 0x20, out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(raw, starts, ends)
