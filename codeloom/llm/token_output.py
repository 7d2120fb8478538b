"""Operator 1: token ids as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id, encoded, ended with an end id and cut into sequences of
`seq_len` ids. A partition becomes one Arrow IPC file whose batches hold fixed-size lists: ids, a mask of real
(not padding) places and a mask of the places where a document starts. All three are flat buffers, so a reader
maps the file and reaches sequence i without copying. `doc_ids` lists the documents that start in each sequence.

A task names its file with a random part and reports it in a manifest, which Spark commits; files of failed or
repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, input_partitions, materialize, shared_path
from .tokens import default_path, encoder

SEQ_LEN, BATCH_SEQUENCES, END_ID = 2048, 256, 2
MANIFEST = "file_no int, path string, n_docs long, n_tokens long, n_sequences long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str, write: bool):
    """A file on any store that Arrow can reach; local ones are mapped."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if write:
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at)
    return pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)


def file_schema(seq_len: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(id_type, seq_len)),
        ("valid", pa.list_(pa.bool_(), seq_len)),
        ("starts", pa.list_(pa.bool_(), seq_len)),
        ("doc_ids", pa.list_(pa.int64())),
    ])


class SequenceWriter:
    """Takes documents' ids one after the other and writes batches of full sequences; close() pads the last one."""

    def __init__(self, sink, seq_len: int, wide: bool):
        self.type, self.kind, self.seq_len = (pa.uint32(), "<u4", seq_len) if wide else (pa.uint16(), "<u2", seq_len)
        self.schema = file_schema(seq_len, self.type)
        self.file, self.sink = pa.ipc.new_file(sink, self.schema), sink
        self.parts: list[bytes] = []
        self.begun: list[tuple[int, int | None]] = []  # place from the first pending id on, and document
        self.pending = self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit values"""
        self.begun.append((self.pending, doc_id))
        self.parts.append(ids)
        self.pending += len(ids) // 4
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.pending >= self.seq_len * BATCH_SEQUENCES:
            self._write(self.pending // self.seq_len)

    def _write(self, rows: int) -> None:
        flat = np.frombuffer(b"".join(self.parts), "<u4").astype(self.kind)
        size = rows * self.seq_len
        starts, valid = np.zeros(size, bool), np.zeros(size, bool)
        now = [(at, d) for at, d in self.begun if at < size]
        starts[[at for at, _ in now]] = True
        valid[: len(flat)] = True
        ids = np.zeros(size, self.kind)
        ids[: len(flat)] = flat[:size]
        per_row = np.concatenate([[0], np.cumsum(starts.reshape(rows, -1).sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(per_row), pa.array([d for _, d in now], pa.int64()))
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, valid, starts)]
        self.file.write_batch(pa.record_batch([*fixed, lists], schema=self.schema))
        self.n_sequences += rows
        self.parts, self.pending = ([flat[size:].astype("<u4").tobytes()], len(flat) - size) if len(flat) > size else ([], 0)
        self.begun = [(at - size, d) for at, d in self.begun if at >= size]

    def close(self) -> None:
        if self.pending:
            self._write(-(-self.pending // self.seq_len))
        self.file.close()
        self.sink.close()


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes `docs` (doc_id, text) to Arrow files under `out`, in ascending doc_id order over all files (nulls first; rows
    of one doc_id by the hash of their text), and returns the manifest, one row per file. Null texts are empty; an empty
    text has just the end id; repeated rows are written each; an empty table gives no file."""
    path = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, end = encoder(path), None, np.array([end_id], "<u4").tobytes()
        wide = max(enc.tokenizer.get_vocab_size(), end_id) > 0xFFFF
        no = TaskContext.get().partitionId()
        to = f"{out}/part-{no:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.many(text.as_py() for text in batch.column(1))):
                writer = writer or SequenceWriter(_open(to, True), seq_len, wide)
                writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "path": [to], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]})

    src = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    dealt = src.repartitionByRange(input_partitions(src), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return materialize(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (unsigned crc32
    of the ids as little-endian unsigned 32-bit integers). Documents are told apart by the start mask alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row["path"], row["base"])

    # one row per file, so a single task holds the running sum
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)))
    files = max(1, manifest.count())
    return based.select("file_no", "path", F.coalesce("base", F.lit(0)).alias("base")).repartitionByRange(files, "file_no").mapInArrow(read, DOCS)


def _documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    done: list[tuple] = []
    now: list | None = None
    with _open(path, False) as source, pa.ipc.open_file(source) as file:
        at = base
        for k in range(file.num_record_batches):
            b = file.get_batch(k)
            valid = b.column(1).flatten().to_numpy(zero_copy_only=False)
            size = int(valid.sum())
            ids = b.column(0).flatten().to_numpy()[:size].astype("<u4")
            cuts = np.flatnonzero(b.column(2).flatten().to_numpy(zero_copy_only=False)).tolist()
            head = cuts[0] if cuts else size
            if now and head:
                now[2], now[3] = now[2] + head, zlib.crc32(ids[:head], now[3])
            for d, i, j in zip(b.column(3).flatten().to_pylist(), cuts, [*cuts[1:], size]):
                if now:
                    done.append(tuple(now))
                now = [d, at + i, j - i, zlib.crc32(ids[i:j])]
            at += size
            if len(done) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=names)
                done = []
    done += [tuple(now)] if now else []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=names)


class SequenceReader:
    """Sequence i of all files of a manifest, in ascending order of file_no. Local files are mapped, so ids are a view of the file and
    a sequence costs the pages that it lies on; of other stores its batch is read. Only `most` files are open at once. The
    manifest's rows (one a file) are gathered; len() is the number of sequences. An index that no sequence has is an
    IndexError."""

    def __init__(self, manifest: DataFrame, most: int = 64):
        rows = manifest.orderBy("file_no").select("path", "n_sequences").collect()
        self.paths = [r["path"] for r in rows]
        self.firsts = [0, *accumulate(r["n_sequences"] for r in rows)]
        self.file = lru_cache(most)(self._file)

    def __len__(self) -> int:
        return self.firsts[-1]

    def _file(self, path: str) -> tuple[pa.RecordBatchFileReader, list[int]]:
        """A file and the first sequence of each of its batches: they have as many as were full when they were written."""
        file = pa.ipc.open_file(_open(path, False))
        return file, [0, *accumulate(file.get_batch(k).num_rows for k in range(file.num_record_batches))]

    def __getitem__(self, i: int) -> dict[str, pa.Array]:
        """ids, valid, starts and doc_ids of a sequence."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        no = bisect_right(self.firsts, i) - 1
        file, firsts = self.file(self.paths[no])
        at = i - self.firsts[no]
        k = bisect_right(firsts, at) - 1
        batch = file.get_batch(k)
        return {name: batch.column(name)[at - firsts[k]].values for name in batch.schema.names}


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` through the file format and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, shared_path(spark, "tokens")))
