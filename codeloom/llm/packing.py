"""Operator 9: best-fit packing by hierarchical residual rounds.

Documents are encoded where they are read and leave the task as piece descriptions, a few dozen bytes each; texts are
never shuffled. Whole-length pieces are sequences already. The others are dealt at random to partitions of a fixed
number of items, each packed by best-fit with lengths in falling order. Nearly full bins are final, and so are bins with
less room than the least bin that is left takes. The other underfull bins become items of the next round, over as many
partitions as they fill, until one partition holds them all. As all bins of a partition but one are over half full, few
are left after a round; should a round leave no fewer than the one before, its bins are final. Items of one length are
placed in the order of a hash, so ties do not depend on the order of rows. Every round is written to the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize
from .tokens import default_path, encoder

CAPACITY, END_ID = 2048, 0
#: Items of one partition in a round; a bin with less room than NEARLY_FULL is final.
ITEMS, NEARLY_FULL = 65_536, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = "final boolean, sequence_id long, total long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def encode_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document's ids plus end id: one, or for longer ones `capacity` ids each, the first one the rest."""
    path = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.many(text.as_py() for text in batch.column(1))):
                ids += end
                n, view = len(ids) // 4, memoryview(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc_id, k, i, j - i, zlib.crc32(view[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Each item, in the given order, goes to the open bin with the least room that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room > length:
            by_room[room - length].append(at)
            rooms |= 1 << (room - length)
    return bins


def _round(items: DataFrame, partitions: int, number: int, last: bool, capacity: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        totals = table.column(0).to_numpy()
        lists = table.column(1).chunk(0)
        edges, flat = lists.offsets.to_numpy(), lists.values
        bins = best_fit(totals.tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64)
        sizes = np.array([len(b) for b in bins])
        first = np.concatenate([[0], np.cumsum(sizes)])
        before = np.concatenate([[0], np.cumsum(totals[order])])
        base = before[:-1] - np.repeat(before[first[:-1]], sizes)  # of each item in its bin
        counts = (edges[1:] - edges[:-1])[order]
        at = np.repeat(edges[:-1][order] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        moved = flat.take(pa.array(at))
        offset = moved.field("offset").to_numpy() + np.repeat(base, counts)
        members = pa.StructArray.from_arrays([pa.array(offset) if f.name == "offset" else moved.field(f.name) for f in MEMBER], fields=list(MEMBER))
        member_edges = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, first[:-1]))]).astype(np.int32)
        total = before[first[1:]] - before[first[:-1]]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array((capacity - total < NEARLY_FULL) | last),
            pa.array((number << 56) + (task << 24) + np.arange(len(bins))),
            pa.array(total),
            pa.ListArray.from_arrays(pa.array(member_edges), members),
        ], names=["final", "sequence_id", "total", "members"])

    first = F.col("members")[0]
    key = F.xxhash64(first["doc_id"], first["piece"], first["ids_crc32"], F.lit(number))
    dealt = items.select("total", "members").withColumn("key", key).repartition(partitions, "key")
    dealt = dealt.sortWithinPartitions(F.desc("total"), "key", first["doc_id"], first["piece"], first["start"])
    return materialize(dealt.select("total", "members").mapInArrow(pack, BINS), f"bins-{number}")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """Packs `docs` (doc_id, text) into sequences of at most `capacity` ids. One row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Null and empty texts are one end id; rows that repeat a doc_id are packed each; texts of
    any length are encoded whole; an empty table gives no rows."""
    pieces = materialize(encode_pieces(docs, tokenizer, end_id, capacity), "pieces")
    whole = pieces.filter(F.col("length") == capacity).select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    rest = rest.select(F.col("length").alias("total"), F.array(F.struct(*rest.columns, F.lit(0).cast("long").alias("offset"))).alias("members"))
    places = lambda bins: bins.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id").select(*whole.columns[:5], "sequence_id", F.col("offset"))
    out, number, left, before = [whole], 1, rest.count(), None
    while left:
        last = left <= items or (before is not None and left >= before)
        bins = _round(rest, -(-left // items), number, last, capacity)
        out.append(places(bins.filter("final")))
        rest = bins.filter("not final")
        least = None if last else rest.agg(F.min("total")).first()[0]
        if least is None:
            break
        takes = F.lit(capacity) - F.col("total") >= least
        out.append(places(rest.filter(~takes)))
        rest, number, before = rest.filter(takes), number + 1, left
        left = rest.count()
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
