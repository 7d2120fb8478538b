"""Operator 6: language-model scores of whole texts by context-tree weighting, beside a word model as the base.

The text that is scored is its token sequence: lower-cased words, each followed by one space, the last one by the end
(a line feed, which no word holds); the end alone for a text without words. Both models see the same tokens.

Training counts are sums over all training documents: every task reduces its documents to distinct (context, byte) and
(word) counts, and Spark adds them up. Contexts that only held-out documents have are in the table with a count of 0. The
tree has one entry per distinct run of DEPTH + 1 bytes at any size. It is never in one place: its branches, all contexts
that end in the same TRUNK bytes, are dealt out. A first pass gives the weights of their stems, from which the driver folds
the trunk; a second one gives the log probability of every context of the corpus, which is written to a table.

Of the words and of the contexts, those over a threshold, at most FREQUENT and CAPACITY, are broadcast. A document's others
leave the task and are joined with the written tables. Every context and word of every document is looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, in_batches, kept, materialize, words_of
from .ctw import DEPTH, Places, Trunk, contexts

#: Contexts and words that are broadcast
CAPACITY, FREQUENT = 1_600_000, 250_000
#: Context bytes of the trunk: it has an entry per distinct run of TRUNK + 1 bytes
TRUNK = 2
END = 0x0A
#: The end's number among the word hashes
END_WORD = np.int64(-1)
#: Numbers that are sorted together
PENDING = 2_000_000
#: Bytes that are looked up together
TOGETHER = 1 << 19
COUNTS = "kind int, key long, n long"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<long>, times array<long>, contexts array<long>"
STEMS = "bit int, path long, total double, ones double, weight double"
LOGS = "key long, n long, log double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def stream_of(text: str | None, depth: int) -> np.ndarray:
    """The token sequence's bytes after `depth` ends that stand for the start."""
    return np.frombuffer(bytes([END]) * depth + b" ".join(words_of(text)) + bytes([END]), np.uint8)


class Common:
    """The contexts that are broadcast, and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        # -1 is no context; it stands for an empty table
        self.keys, self.logs = (keys, logs) if len(keys) else (np.array([-1]), np.zeros(1))
        self.places: Places | None = None  # made where it is used, so it is not sent

    def log10(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each byte in its context, 0 where the context is not here, and where that is."""
        if self.places is None:
            self.places = Places(self.keys)
        at = self.places.of(key)
        return np.where(at < 0, 0.0, self.logs[at]), np.flatnonzero(at < 0)


def log10_of(streams: Iterable[np.ndarray], common: Common, depth: int) -> Iterator[tuple[int, float, np.ndarray]]:
    """Bytes and log10 probability of each stream's common contexts, and its other contexts. Streams are looked up together,
    TOGETHER bytes or a little more at a time."""
    held: list[np.ndarray] = []

    def sums() -> Iterator[tuple[int, float, np.ndarray]]:
        sizes = [len(x) for x in held]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        keys = np.concatenate(held)
        logs, new = common.log10(keys)
        yield from zip(sizes, np.add.reduceat(logs, first).tolist(), np.split(keys[new], np.searchsorted(new, first[1:])))

    size = 0
    for stream in streams:
        held.append(contexts(stream, depth))
        size += len(held[-1])
        if size >= TOGETHER:
            yield from sums()
            held, size = [], 0
    if held:
        yield from sums()


class _Sums:
    """Adds up counts of numbers. Pending ones are sorted and merged into the sums when they are PENDING or as many as these."""

    def __init__(self):
        self.keys, self.counts, self.pending, self.size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(keys)
        self.size += len(keys)
        if self.size > max(PENDING, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.size:
            new = np.concatenate(self.pending)
            self.pending, self.size = [], 0
            new.sort()
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            counts = np.concatenate([self.counts, np.diff(first, append=len(new))])
            keys = np.concatenate([self.keys, new[first]])
            del new, first
            order = np.argsort(keys, kind="stable")  # two sorted runs
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        return self.keys, self.counts


def count(docs: DataFrame, depth: int) -> DataFrame:
    """kind (0: byte in context, 1: word), key, n over the rows of docs (doc_id, text, held_out) that are not held out. The
    contexts of held-out rows are there too, and count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm")
        # a context is doubled, and 1 added if it is trained on
        found, words = _Sums(), _Sums()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                trained = 0
                for value, out in zip(part.column(1), part.column(2)):
                    text, learn = value.as_py(), not out.as_py()
                    found.add(contexts(stream_of(text, depth), depth) << 1 | int(learn))
                    if learn:
                        words.add(hashed_words(text).view(np.int64))
                        trained += 1
                words.add(np.full(trained, END_WORD))
        for kind, sums in enumerate((found, words)):
            keys, counts = sums.merge()
            if not kind:  # held-out ones that the task has trained on are known already
                alone = np.append((keys[:-1] | 1) != keys[1:], True)[: len(keys)] | ((keys & 1) == 1)
                keys, counts = keys[alone], counts[alone]
            for at in range(0, len(keys), 100_000):
                key, n = keys[at : at + 100_000], counts[at : at + 100_000]
                key, n = (key, n) if kind else (key >> 1, n * (key & 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

    # tasks have added up their own rows, so there is nothing to add up before the shuffle
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, COUNTS).repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _numbers(df: DataFrame, column: str = "n") -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", column).toArrow()
    keys, values = (table.column(k).to_numpy() for k in ("key", column))
    order = np.argsort(keys)
    return keys[order], values[order]


def _branch(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All (key, n) of a task, by rising key."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    keys, counts = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    order = np.argsort(keys)
    return keys[order], counts[order]


def logs(counted: DataFrame, depth: int) -> DataFrame:
    """key, n, log: log10 of the probability of the byte in its context, for all rows of `counted` (key, n), whose n are the
    counts in training. Every context has its full depth."""
    first = min(TRUNK, depth)
    dealt = counted.select("key", "n").repartition(F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * first)) - 1)))

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm")
        keys, counts = _branch(batches)
        seen = counts > 0
        for bit, columns in enumerate(Trunk.weights(keys[seen], counts[seen], first, depth)):
            n = len(columns[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bit, np.int32)), pa.array(columns[0]), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["bit", "path", "total", "ones", "weight"])

    table = dealt.mapInArrow(stems, STEMS).toArrow()
    bits, *columns = (table.column(k).to_numpy() for k in ("bit", "path", "total", "ones", "weight"))
    sent = counted.sparkSession.sparkContext.broadcast(Trunk(first, [tuple(c[bits == bit] for c in columns) for bit in range(8)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm")
        keys, counts = _branch(batches)
        seen = counts > 0
        found = sent.value.log10(keys[seen], counts[seen], keys, depth)
        for at in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 500_000]) for c in (keys, counts, found)], names=["key", "n", "log"])

    return dealt.mapInArrow(run, LOGS)


def frequent(table: DataFrame, most: int = FREQUENT, column: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """Keys and `column` of all rows of the highest powers of two of n that are `most` rows together."""
    by_size = sorted(((r["p"], r["c"]) for r in table.filter("n > 0").groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for p, c in by_size:
        total += c
        if total > most:
            break
        least = 1 << p
    return (np.empty(0, np.int64), np.empty(0, np.int64)) if least is None else _numbers(table.filter(F.col("n") >= least), column)


def scores(docs: DataFrame, depth: int = DEPTH, capacity: int = CAPACITY, most: int = FREQUENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of
    the model's probability of the token sequence) and bits_per_byte (its code length per byte). Rows whose crc32(doc_id)
    mod 7 is 2 are held out of training. Null, empty and wordless texts are the end token alone; rows without doc_id are
    trained on; repeated rows count and are scored each. Without training rows every bit has probability 1/2. `capacity` and
    `most` bound what is broadcast and do not change results."""
    spark = docs.sparkSession
    own = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counted = materialize(count(own, depth), "lm-counts")
    known = materialize(logs(counted.filter("kind = 0"), depth), "lm-logs")
    words = counted.filter("kind = 1").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sent = spark.sparkContext.broadcast((Common(*frequent(known, capacity, "log")), *frequent(words, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lm")
        likely, common, times = sent.value
        gain = np.log10(times + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(9)]
                streams = (stream_of(value.as_py(), depth) for value in part.column(1))
                for value, (length, log10, others) in zip(part.column(1), log10_of(streams, likely, depth)):
                    text = value.as_py()
                    hashes = np.append(hashed_words(text).view(np.int64), END_WORD)
                    found = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
                    hit = common[found] == hashes if len(common) else np.zeros(len(hashes), bool)
                    rare, rare_times = np.unique(hashes[~hit], return_counts=True)
                    for column, x in zip(out, (row, len(hashes), int(hit.sum()), float(gain[found[hit]].sum()) if hit.any() else 0.0, log10, length, rare, rare_times, others)):
                        column.append(x)
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
                c = [pa.array(x, t) for x, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([c[0], part.column(0), part.column(2), *c[1:]], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare", "times", "contexts"])

    scored = materialize(own.mapInArrow(run, SCORED), "lm-scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), "w.times")
    rest = pairs.join(words, "key").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    others = scored.select("row", F.explode("contexts").alias("key")).join(known.select("key", "log"), "key").groupBy("row").agg(F.sum("log").alias("more_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare", "times", "contexts").join(rest, "row", "left").join(others, "row", "left").withColumn("score", F.col("score") + zero("more_score")).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score", (-F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
