"""Operator 2: toxicity of whole texts by the network of gru.py, over windows that overlap by half.

The network is trained in numpy on the driver, on a sample of labelled documents that SAMPLE bounds for each label; the
sample is the rows of least doc_id hash, so it does not depend on the order of rows; of a repeated doc_id it has the least
text, and it leaves out texts over LONGEST bytes, so its size has a bound. The network starts from what the sample says of
single words: the first dimension of a word's embedding is its smoothed log odds of label 1, clipped, and the windows of the
first epoch are those with the largest one. A word's characters enter as the mean of its hashed trigrams' embeddings. The trained network is a few
hundred kilobytes and is broadcast. Scoring reads every word of every text where it is stored; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, kept, words_of
from .gru import Network, train

#: Labelled documents of each label that training reads, the bytes of the longest one that it reads, and the score from which a
#: text is toxic.
SAMPLE, LONGEST, THRESHOLD = {1: 1200, 0: 1800}, 32_768, 0.3


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Network | float:
    """Trains on `docs` (doc_id, text) and `labels` (doc_id, toxic). A doc_id with several labels has the largest one; rows
    without doc_id, text or label are not used. Without examples of both labels there is no network but a constant."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y")).filter("y in (0, 1)")
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not (sizes.get(0) and sizes.get(1)):
        return prior
    chosen = None
    for y, n in sample.items():
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sum(sample) rows of 16 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST))
    # at most sum(sample) rows of LONGEST bytes
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["y"] for r in rows], np.int64)
    if not len(rows) or y.min() == y.max():
        return prior
    return train([words_of(r["text"], "alnum") for r in rows], y, prior)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """row (all columns of `docs`, which has text) and score. Null, empty and wordless texts have the score of the network's bias."""
    # the text is sent once, within its row
    out, at_text = in_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), docs.columns.index("text")
    if not isinstance(model, Network):
        return out.select("row", F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        net = sent.value
        for batch in batches:
            texts = batch.column(0).field(at_text)
            scores = [net.score([words_of(t.as_py(), "alnum") for t in texts.slice(at, 128)]) for at in range(0, batch.num_rows, 128)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0), *scores]))], names=["row", "score"])

    return out.mapInArrow(run, f"row {out.schema['row'].dataType.simpleString()}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, by `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
