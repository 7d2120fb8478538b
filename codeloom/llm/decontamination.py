"""Operator 7: benchmark decontamination with an FM-index per training shard.

Benchmark items are cut into windows of ten words. A shard (a batch of documents of one task) keeps, of its words, the
runs that consist of benchmark words only and are as long as the shortest window; no other place can hold a window.
An FM-index over these runs is searched backwards for all windows at once, occurrences are located by sampled suffix
positions, mapped to words of documents and merged into spans. Texts are never shuffled.

The benchmark is taken in blocks of bounded size, each read, numbered and broadcast by itself. One pass over the texts
searches every block in every shard; workers hold all blocks, about five times the benchmark's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, words_of
from .fmindex import FMIndex

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds, words under one FM-index, and windows that are searched together.
BLOCK_BYTES, SHARD_WORDS, TOGETHER = 4_000_000, 2_000_000, 1 << 18
SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
FOUND = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class Phrases:
    """The distinct windows of some items, by length: places in one array of all the items' words, numbered from 1, and the items
    that each window is in. A word takes four bytes, a window about twenty."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item_id for item_id, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        parts, starts, owners, size = [], {}, {}, 0
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text, "alnum")], np.int32)
            width = min(window, len(ids))
            if width:
                starts.setdefault(width, []).append(np.arange(size, size + len(ids) - width + 1))
                owners.setdefault(width, []).append(np.full(len(ids) - width + 1, number[item_id], np.int64))
            parts.append(ids)
            size += len(ids)
        self.ids = np.concatenate([np.empty(0, np.int32), *parts])
        self.groups = []  # width, places of the distinct windows, and where each one's items begin in the last
        for width in sorted(starts):
            at, own = np.concatenate(starts[width]), np.concatenate(owners[width])
            rows = np.ascontiguousarray(self.ids[at[:, None] + np.arange(width)]).view(np.dtype((np.void, 4 * width))).ravel()
            _, first, which = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(which * len(self.names) + own)
            edges = np.searchsorted(pairs // len(self.names), np.arange(len(first) + 1))
            self.groups.append((width, at[first], edges, (pairs % len(self.names)).astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0

    def patterns(self, width: int, places: np.ndarray) -> np.ndarray:
        return self.ids[places[:, None] + np.arange(width)].astype(np.int64)


def _runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Runs [from, to) of non-zero ids of at least that length."""
    edge = np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _search(shard: list[tuple[int, int, np.ndarray]], phrases: Phrases, spans: list[list], items: list[set]) -> None:
    """shard: (document, first word, ids of a run). Adds what occurs to the documents' spans and items."""
    text = np.concatenate([x for _, _, ids in shard for x in (ids, [0])])
    sizes = np.array([len(ids) + 1 for _, _, ids in shard])
    starts = np.cumsum(sizes) - sizes
    index = FMIndex(text)
    for width, places, edges, owners in phrases.groups:
        for part in range(0, len(places), TOGETHER):
            low, high = index.search(phrases.patterns(width, places[part : part + TOGETHER]))
            times = high - low
            if not times.sum():
                continue
            which = np.repeat(np.arange(part, part + len(times)), times)
            rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            at = index.locate(rows)
            run = np.searchsorted(starts, at, "right") - 1
            for k, w, offset in zip(run.tolist(), which.tolist(), (at - starts[run]).tolist()):
                doc, first, _ = shard[k]
                spans[doc].append((first + offset, first + offset + width))
                items[doc].update(phrases.names[o] for o in owners[edges[w] : edges[w + 1]].tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans [first, last) as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _scan(blocks: list, at_text: int) -> object:
    """For mapInArrow: rows (row, with the text as field at_text) -> the same with `found`. blocks: broadcast Phrases; each shard of each is searched."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            n_words: list[int] = []
            texts = batch.column(0).field(at_text)
            for no, block in enumerate(b.value for b in blocks):
                number, shortest = block.vocabulary.get, max(1, block.shortest)
                shard, size = [], 0
                for doc, text in enumerate(texts):
                    words = words_of(text.as_py(), "alnum")
                    if not no:
                        n_words.append(len(words))
                    ids = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
                    for a, b in _runs(ids, shortest) if block.groups else ():
                        shard.append((doc, a, ids[a:b]))
                        size += b - a
                    if size >= SHARD_WORDS:
                        _search(shard, block, spans, items)
                        shard, size = [], 0
                if shard:
                    _search(shard, block, spans, items)
            joined = [merged(s) for s in spans]
            edges = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in joined])]).astype(np.int32))
            flat = np.array([x for s in joined for x in s], np.int64).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(SPAN))
            found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(edges, pairs), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["n_words", "spans", "items"])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (all columns of `docs`, which has text), found (n_words, spans of words [first, last) to remove, items with an
    occurring window, sorted as strings). Words are lower-cased (A-Z) runs outside ASCII non-alphanumerics. A window is
    `window` consecutive words of an item (item_id, text), or all of a shorter one. Null and empty texts have no words;
    rows that repeat an item_id are one item, a null item_id is the empty string; an empty benchmark finds nothing."""
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    out = in_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row_type = out.schema["row"].dataType.simpleString()
    sent = []
    for k in range(blocks):
        # one block, of about block_bytes; an item is never split
        items = [(r["item_id"], r["text"]) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        sent.append(spark.sparkContext.broadcast(Phrases(items, window)))
    return out.mapInArrow(_scan(sent, docs.columns.index("text")), f"row {row_type}, found struct<n_words:long,spans:array<struct<first:long,last:long>>,items:array<string>>")


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the separators between them."""
    from .common import TABLES

    raw = (text or "").encode()
    plain = np.frombuffer(raw.translate(TABLES["alnum"]), np.uint8) if raw else np.empty(0, np.uint8)
    inside = (plain != 0x20) & ((plain < 0x09) | (plain > 0x0D))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*out, raw[at:]]).decode()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = decontaminate(read("documents").select("doc_id", "text"), read("benchmark"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return out.select(
        "row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
