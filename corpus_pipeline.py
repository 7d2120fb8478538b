"""A corpus from raw documents to packed sequences. Every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialize
from codeloom.llm.decontamination import decontaminate
from codeloom.llm.minhash import BROADCAST_ROWS, near_duplicates
from codeloom.llm.packing import pack
from codeloom.llm.toxicity import THRESHOLD, fit, score

#: Similarity in percent from which a document is a near duplicate, and the equal coordinates of 48 that a pair must have to be
#: confirmed: fewer have a chance of 3.4e-6 at that similarity
PART, MATCH = 80, 25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The network learns from the labels of the documents at hand. Null and empty
    texts are scored like any other; equal rows have equal scores."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).filter(F.col("score") < THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity of PART percent or more), the document with the smallest doc_id. A row goes if
    its own text is a duplicate, so another text under the same doc_id stays, and equal rows go or stay together. Null, empty
    and wordless texts and rows without a doc_id stay."""
    found = near_duplicates(docs, part=PART, match=MATCH).filter("not kept")
    gone = materialize(found.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct(), "duplicates")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have no words and stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("found.spans") == 0).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. Null and empty texts are one end id; equal rows are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No stage can be expressed in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result written and read again as the next one's documents. No documents give no
    sequences. Columns besides doc_id and text pass through all stages but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else materialize(docs, f"stage-{name}")
    return docs
