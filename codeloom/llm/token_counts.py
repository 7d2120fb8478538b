"""Operator 10: token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Each token has a span of UTF-8 bytes, from the summed lengths of the pieces before
it, and each section (by default a line) has one too. Both are sorted, so the interval join is a binary search. A token
that crosses a boundary counts for the section that holds most of its bytes, the first one on a tie; bytes between
sections (the line ends) belong to the section before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches
from .tokens import default_path, encoder

COUNTS = "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long"


def attribute(ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section. ends: the byte after each token; cuts: first byte of each section, from 0."""
    starts = np.concatenate([[0], ends])[:-1]
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.maximum(np.searchsorted(cuts, ends, "left") - 1, first)
    owner, crossing = first.copy(), last > first
    edges = np.concatenate([cuts, [ends[-1] if len(ends) else 0]])
    for k in np.flatnonzero(crossing):
        within = range(first[k], last[k] + 1)
        owner[k] = max(within, key=lambda s: (min(ends[k], edges[s + 1]) - max(starts[k], edges[s]), -s))
    n = len(cuts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per section (line, from 0) of `docs` (doc_id, text): doc_id, section, start and n_chars in code points without the line end,
    n_tokens, n_crossing (those of n_tokens that reach over a boundary). n_tokens sums to the whole text's tokens. Null and
    empty texts have one section of 0 tokens; repeated rows are counted each."""
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        lengths = enc.__dict__.setdefault("lengths", None)
        if lengths is None:
            lengths = enc.lengths = enc.byte_lengths()
        for batch in batches:
            ids_of: list[int | None] = []
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            texts, again = tee(value.as_py() or "" for value in batch.column(1))
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), texts, enc.many(again)):
                ends = np.cumsum(lengths[np.frombuffer(ids, "<u4")])
                raw = np.frombuffer(text.encode(), np.uint8)
                breaks = np.flatnonzero(raw == 0x0A)
                cuts = np.concatenate([[0], breaks + 1])
                tokens, crossing = attribute(ends, cuts)
                if len(raw) == len(text):
                    chars_before, n = cuts, len(text)
                else:
                    run = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    chars_before, n = run[cuts], int(run[-1])
                sizes = np.concatenate([chars_before[1:] - 1, [n]]) - chars_before
                ids_of += [doc_id] * len(cuts)
                for part, x in zip(parts, (np.arange(len(cuts)), chars_before, sizes, tokens, crossing)):
                    part.append(x)
            if ids_of:
                columns = [pa.array(ids_of, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of `documents`."""
    return section_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
