"""Operator 11: a Merkle manifest of a dataset, with an authentication path for every row.

Rows become leaves in the scan. Leaves of one tree (a source) are numbered by a range sort; ARITY consecutive nodes become
their parent until one is left, and the roots of all trees, in the order of their names, become one root in the same way.

Paths come from a fractal traversal of aligned blocks of ARITY ** LEVELS leaves. A block keeps one existing subtree for each of
its levels, which holds the siblings of the leaf at hand, and one desired subtree, which takes in a leaf a step and is whole when
the existing one is used up. So the state of a block is 2 x ARITY digests a level, however many paths it emits. What is
above a block is computed for block roots in the same way, block by block, and is appended to the paths of its leaves.

Nulls are leaves like any other value; a null tree name is a tree of its own, before all others; rows without a number come
first in their tree; rows of one number follow each other by leaf, and equal rows are interchangeable. Empty tables have
no row. All columns of the rows pass through in a struct, so no name can clash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, Scratch, input_partitions

#: Children of a node, and levels of a block: it has ARITY ** LEVELS leaves
ARITY, LEVELS = 16, 3
STEP = "struct<before: string, after: string>"


def digest_of(*fields: Column) -> Column:
    """The leaf of a row: SHA-256 of its fields, each "-" if null, else its UTF-8 bytes' count, ":" and the value."""
    shown = []
    for f in fields:
        value = f.cast("string")
        shown.append(F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*shown), 256)


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Subtree:
    """Takes in the leaves of one subtree, one after the other, and keeps the nodes below its root: of every other level, only
    the run that is not folded yet."""

    def __init__(self, level: int):
        self.level, self.runs = level, [[] for _ in range(level + 1)]

    def feed(self, leaf: str) -> None:
        self.runs[0].append(leaf)
        for h in range(self.level):
            if len(self.runs[h]) < ARITY:
                return
            self.runs[h + 1].append(joined(self.runs[h]))
            self.runs[h] = []

    def close(self) -> list[str]:
        """The nodes; runs that the end of the leaves cut short become nodes too."""
        for h in range(self.level):
            if self.runs[h]:
                self.runs[h + 1].append(joined(self.runs[h]))
                self.runs[h] = []
        return self.runs[self.level]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf through `levels` levels: per level, the siblings before and after its node, joined."""
    spans = [ARITY ** (i + 1) for i in range(levels)]
    existing: list[list[str]] = []
    for i, span in enumerate(spans):
        first = Subtree(i)
        for leaf in leaves[:span]:
            first.feed(leaf)
        existing.append(first.close())
    desired, shown = [Subtree(i) for i in range(levels)], [("", "")] * levels
    for k in range(len(leaves)):
        for i, span in enumerate(spans):
            if k % (span // ARITY):
                break  # the node at this level, and at all above it, is still the same
            j = (k // (span // ARITY)) % ARITY
            shown[i] = "".join(existing[i][:j]), "".join(existing[i][j + 1 :])
        yield list(shown)
        for i, span in enumerate(spans):
            if k + span < len(leaves):
                desired[i].feed(leaves[k + span])
            if (k + 1) % span == 0:
                existing[i], desired[i] = desired[i].close(), Subtree(i)


def numbered(rows: DataFrame, *order: str, scratch: Scratch) -> DataFrame:
    """rows with `pos`, their place in their `tree` by `order`, and `n`, the rows of that tree. They are sorted by ranges and
    written; only rows per tree and part are counted, so a tree may be of any size."""
    dealt = rows.repartitionByRange(input_partitions(rows), "tree", *order).sortWithinPartitions("tree", *order)
    written = scratch.write(dealt.withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_row", 33))
    whole = Window.partitionBy("tree")
    counts = written.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return written.join(placed, ["tree", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def block_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One node (tree, pos, n, digest) for each aligned block of nodes: `levels` levels up, or as far as the tree goes."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x.digest)
    single = F.col("n") == 1  # of blocks: the block is its tree

    def parents(d: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / ARITY).cast("int")), lambda k: F.sha2(F.array_join(F.slice(d, k * ARITY + 1, ARITY), ""), 256))
        return F.when(single & (F.size(d) == 1), d).otherwise(runs)

    out = nodes.groupBy("tree", F.floor(F.col("pos") / ARITY**levels).alias("pos"), F.ceil(F.col("n") / ARITY**levels).alias("n")).agg(digests.alias("nodes"))
    for _ in range(levels):
        out = out.withColumn("nodes", parents(F.col("nodes")))
    return out.select("tree", "pos", "n", F.col("nodes")[0].alias("digest"))


def authenticate(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes with their `path` and what `above` (tree, pos, path, and names of roots) has of their blocks."""
    block, more = F.floor(F.col("pos") / ARITY**levels), [c for c in above.columns if c not in ("tree", "pos", "path")]
    schema, kept = StructType([*nodes.schema, *(above.schema[c] for c in ("path", *more))]), list(nodes.columns)

    def emit(rows: pa.Table, over: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        top, high, wide = over.slice(0, 1).to_pylist()[0], 0, rows["n"][0].as_py()
        while wide > 1 and high < levels:
            wide, high = -(-wide // ARITY), high + 1
        rest = [(s["before"], s["after"]) for s in top["path"]]
        steps = [s for path in traverse(rows["digest"].to_pylist(), high) for s in (*path, *rest)]
        size = high + len(rest)
        flat = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in range(2)], names=["before", "after"])
        paths = pa.ListArray.from_arrays(pa.array([k * size for k in range(len(rows) + 1)], pa.int32()), flat)
        return pa.Table.from_arrays([*(rows[c] for c in kept), paths, *(pa.array([top[c]] * len(rows), pa.string()) for c in more)], names=[*kept, "path", *more])

    left, right = nodes.withColumn("_block", block), above.withColumnRenamed("pos", "_block")
    return left.groupBy("tree", "_block").cogroup(right.groupBy("tree", "_block")).applyInArrow(emit, schema)


def ascend(nodes: DataFrame, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """tree, pos, path, top: the path of every node to the root of its tree, and that root."""
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("top"))
    higher = ascend(scratch.write(block_roots(nodes, levels), "blocks"), scratch, levels)
    return scratch.write(authenticate(nodes, higher, levels).select("tree", "pos", "path", "top"), "paths")


def manifest(rows: DataFrame, leaf: str, tree: str, number: str, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """`row`, a struct of the columns of rows, with `pos`, its place in the tree that the column `tree` names (ordered by the
    column `number`), `path` (from the column `leaf` to the root: the siblings before and after the node of each level, joined),
    `subroot` and `root`. Tables of nodes go to `scratch`; the caller drops them once it has read the result."""
    # a name that sorts as the tree does: null, then by bytes
    name = F.coalesce(F.concat(F.lit("="), rows[tree]), F.lit("-"))
    found = scratch.write(rows.select(name.alias("tree"), rows[number].alias("_number"), rows[leaf].alias("digest"), F.struct(*(rows[c] for c in rows.columns)).alias("row")), "leaves")
    nodes = numbered(found.withColumn("_tie", F.monotonically_increasing_id()), "_number", "digest", "_tie", scratch=scratch).drop("_tie", "_number")
    below = ascend(scratch.write(block_roots(nodes, levels), "blocks"), scratch, levels)
    trees = below.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    trees = scratch.write(numbered(trees, "name", scratch=scratch), "trees")
    over = ascend(trees, scratch, levels).join(trees.select("pos", "name"), "pos").select(F.col("name").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root"))
    above = below.join(over, "tree").select("tree", "pos", F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root")
    return authenticate(nodes, scratch.write(above, "above"), levels).select("row", "pos", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step.before, below, step.after), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    """All of `documents`, one tree for each source, proven once as they are and once after a fifth of the rows was changed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf, tampered = digest_of(*fields, F.col("text")), digest_of(*fields, F.translate("text", UPPER, LOWER))
    scratch = Scratch(spark, "merkle")
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(changed, tampered).alias("tampered"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    out = manifest(rows, "leaf", "source", "doc_id", scratch, levels).select(
        "row.doc_id", "row.leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("row.tampered", "row.leaf"), F.col("path")).alias("folded_root")
    )
    return scratch.last(out.withColumn("verified", F.col("folded_root") == F.col("root")))
