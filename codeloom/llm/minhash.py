"""Operator 3: near-duplicate documents by an inverted join on MinHash coordinates.

1. Texts with the same shingle set become one class. A class has a number of its own, and the least doc_id of its texts;
   the former is its identity in everything that follows, the latter only its label.
2. Every class has COORDS MinHash values. (coordinate, value) pairs that only one class has cannot collide and are
   dropped; a class left with fewer than MATCH of them cannot match any other and is out.
3. Of the others, the pairs are sorted by rising frequency. Two classes that collide in MATCH coordinates must share
   one of the first size - MATCH + 1, so only this prefix is posted; the rest is skipped and only counted for pairs
   that meet in a prefix. At Jaccard 0.85, the chance of fewer than 28 collisions in 48 is below 1e-5.
4. Pairs with MATCH collisions are confirmed on the full shingle sets.

A list of near copies is not expanded into all its pairs. Each list first links its members to two centres. Links
merge classes into components, and only members of different components still meet. A pair is tried only if the
shingles of each side that any other class has are numerous enough for the threshold, and if the parities of the sets'
hash buckets differ in few enough places; both are exact bounds.

A centre meets every member of its list, so its class is one key of the joins that confirm pairs. These joins read written
pairs and nothing that needs its rows by the same key follows them, so adaptive execution can split such a key over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_batches, kept
from .components import components
from .shingles import MinHash, set_key, shingle_set

COORDS, MATCH, PART, WHOLE = 48, 28, 85, 100
#: Bits of the parity sketch of a set
SKETCH = 1024
#: Representatives (8 bytes each) up to which the second scan's filter is broadcast; beyond, it is a shuffled join.
BROADCAST_ROWS = 1_000_000


def signatures(docs: DataFrame, coords: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), k1, k2 (128 bits that equal sets share), sig (null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("minhash")
        minhash = MinHash(coords)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, minhash.signatures([sets[k] for k in full])):
                        sig[k] = row
                keys = [set_key(s) for s in sets]
                columns = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*keys)), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "k1", "k2", "sig"])

    own = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(sign, "doc_id long, text_hash long, n long, k1 long, k2 long, sig array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, shingles: the sorted shingle hashes of each row of docs (doc_id, text); odd: which of SKETCH buckets hold an odd
    number of them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(t.as_py()) for t in part.column(1)]
                keys = zip(*map(set_key, found))
                odd = [np.packbits(np.bincount(s.view(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64) for s in found]
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in keys), *(pa.array(c, pa.list_(pa.int64())) for c in ([s.view(np.int64) for s in found], odd))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "shingles", "odd"])

    return docs.mapInArrow(sets, "doc_id long, k1 long, k2 long, shingles array<long>, odd array<long>")


def _can_link(shared: Column, n: Column, other: Column, part: int, whole: int) -> Column:
    """|x & y| >= part/whole |x | y| needs (part + whole) |x & y| >= part (|x| + |y|), and x shares `shared` shingles with anyone at most."""
    return (part + whole) * shared >= part * (n + other)


def _collisions(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _may_be_close(odd_a: Column, odd_b: Column, n: Column, part: int, whole: int) -> Column:
    """Buckets whose parity differs are |A ^ B| at most, and |A & B| is half of n = |A| + |B| less |A ^ B|. An exact bound."""
    apart = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (part + whole) * (n - apart) >= 2 * part * n


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, match: int, part: int, whole: int, name: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that collide often enough and whose full sets are similar enough."""
    side = lambda t, col, k: t.select(F.col("rep").alias(k), F.col(col).alias(f"{col}_{k}"))
    pairs = scratch.write(pairs, f"{name}-pairs")
    hits = pairs.join(side(classes, "sig", "a"), "a").join(side(classes, "sig", "b"), "b")
    hits = scratch.write(hits.filter(_collisions("sig_a", "sig_b") >= match).select("a", "b"), f"{name}-matches")
    both = hits.join(side(sets, "shingles", "a"), "a").join(side(sets, "shingles", "b"), "b")
    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = both.select("a", "b", inter.alias("i"), (F.size("shingles_a") + F.size("shingles_b")).alias("t"))
    return scratch.write(both.filter(whole * F.col("i") >= part * (F.col("t") - F.col("i"))).select("a", "b"), f"{name}-links")


def near_duplicates(docs: DataFrame, part: int = PART, whole: int = WHOLE, coords: int = COORDS, match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of `docs` (doc_id, text).

    Documents are linked if whole * |A & B| >= part * |A | B| for their sets of five-word shingles. component_id is the
    smallest doc_id reachable over links. Null, empty and wordless texts have no shingle and are linked with nothing, as
    are rows without a doc_id (component_id null, kept). Of rows that repeat a doc_id, each has the component of its
    own text; equal rows have equal results. Very long texts are taken whole, an empty table gives no rows. The result is
    a written table; all others that it took are deleted."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(signatures(docs, coords), "signatures")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay

    posted = classes.select("rep", F.posexplode("sig")).select("rep", F.xxhash64("pos", "col").alias("key"))
    frequent = posted.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    of_class = posted.join(frequent, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    prefix = F.slice("keys", F.lit(1), F.size("keys") - match + 1)
    family = scratch.write(of_class.filter(F.size("keys") >= match).select("rep", F.transform(prefix, lambda x: x["key"]).alias("keys")), "postings")

    few = family.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda t: t
    wanted = classes.join(small(family.select("rep")), "rep", "left_semi").select(F.col("doc").alias("doc_id"), "k1", "k2", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    # a doc_id may have other texts besides its class's, and a text may be there twice
    sets = shingle_sets(texts).join(small(wanted), ["doc_id", "k1", "k2"]).groupBy("rep").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
    sets = scratch.write(sets, "shingles")
    lone = sets.select("rep", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    sizes = sets.select("rep", F.size("shingles").cast("long").alias("n")).join(lone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"))
    lists = scratch.write(family.select("rep", F.explode("keys").alias("key")).join(sizes, "rep").filter(whole * F.col("shared") >= part * F.col("n")), "lists")

    member = F.struct("rep", "n", "shared")
    centres = lists.groupBy("key").agg(F.max_by(member, F.struct(F.col("shared") / F.col("n"), -F.col("rep"))).alias("c1"), F.min_by(member, F.xxhash64("rep", "key")).alias("c2"), F.count("*").alias("c")).filter("c > 1")
    met = lists.join(centres.select("key", "c1", "c2"), "key").select("rep", "n", "shared", F.explode(F.array("c1", "c2")).alias("c"))
    met = met.filter((F.col("rep") != F.col("c.rep")) & _can_link(F.least("shared", "c.shared"), F.col("n"), F.col("c.n"), part, whole))
    links = _confirmed(met.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct(), classes, sets, match, part, whole, "centre", scratch)

    labels = scratch.write(components(links, scratch), "labels").withColumnRenamed("node", "rep")
    labelled = lists.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_lists = lambda t: t.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).filter("lo <> hi").select("key", "least")
    rest = labelled.join(open_lists(labelled), "key").filter(_can_link(F.col("shared"), F.col("n"), F.col("least"), part, whole)).drop("least")
    rest = rest.join(open_lists(rest), "key").drop("least")
    # a pair counts its collisions in the first list that both are posted in, and skips the other lists
    held = family.join(classes.select("rep", "sig"), "rep").join(sets.select("rep", "odd"), "rep")
    rest = scratch.write(rest.join(held, "rep"), "open")
    x, y = rest.alias("x"), rest.alias("y")
    crossing = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label"))
    crossing &= _can_link(F.least("x.shared", "y.shared"), F.col("x.n"), F.col("y.n"), part, whole)
    crossing &= F.col("x.key") == F.array_intersect("x.keys", "y.keys")[0]
    crossing &= _may_be_close(F.col("x.odd"), F.col("y.odd"), F.col("x.n") + F.col("y.n"), part, whole)
    crossing &= _collisions("x.sig", "y.sig") >= match
    more = _confirmed(x.join(y, crossing).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), classes, sets, match, part, whole, "cross", scratch)

    labels = scratch.write(components(links.unionByName(more), scratch), "labels").withColumnRenamed("node", "rep")
    linked = labels.join(classes.select("rep", "k1", "k2", "doc"), "rep")
    least = scratch.write(linked.groupBy("label").agg(F.min("doc").alias("component")), "least")
    named = linked.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "label").select("k1", "k2", "component")
    alone = classes.join(labels.select("rep"), "rep", "left_anti").select("k1", "k2", F.col("doc").alias("component"))
    out = signed.drop("sig").join(named.unionByName(alone), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", own)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
    return scratch.last(out)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
