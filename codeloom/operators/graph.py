"""Dependency graph: coupling, instability, distance, cycles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import forget, stored

#: Edges up to which one task holds the whole graph; beyond, it stays distributed. Both ways give the same components.
SMALL = 1_000_000


def coupling(edges: DataFrame) -> DataFrame:
    """node, ce (outgoing), ca (incoming), instability for every node, leaves included. One aggregation over both roles."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.o").alias("ce"), F.sum("e.i").alias("ca"))
    return counts.select("node", "ce", "ca", F.when(F.col("ce") + F.col("ca") > 0, F.col("ce") / (F.col("ce") + F.col("ca"))).otherwise(0.0).alias("instability"))


def distance(abstractness: Column, instability: Column) -> Column:
    """From the main sequence, on which abstractness and instability add up to 1."""
    return F.abs(abstractness + instability - 1)


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges without those that start or end at a node that nothing leads to or that leads nowhere, until none is left."""
    before, now = -1, edges.count()
    while now != before and now:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = stored(kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
        forget(edges)
        edges, before, now = kept, now, kept.count()
    return edges, now


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least label among those of the nodes that lead to the node and its own. One row per node at any time."""
    labels = stored(labels, "labels")
    while True:
        sent = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("sent"))
        following = stored(labels.join(sent, F.col("dst") == F.col("node"), "left").select("node", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("changed")), "labels")
        forget(labels)
        labels, done = following.select("node", "label"), following.filter("changed").isEmpty()
        labels._codeloom_path = following._codeloom_path
        if done:
            return labels


def components_of(pairs: list[tuple]) -> Iterator[tuple]:
    """(node, least node of its strongly connected component) for components of several nodes: nodes in the order in which a
    depth-first walk leaves them, then, the last one first, walks over the edges the other way round. No recursion."""
    out: dict = {}
    into: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    left, seen = [], set()
    for root in out:
        stack = [] if root in seen else [(root, iter(out[root]))]
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                left.append(stack.pop()[0])
            else:
                seen.add(following)
                stack.append((following, iter(out.get(following, ()))))
    done: set = set()
    for root in reversed(left):
        if root in done:
            continue
        done.add(root)
        group, stack = [root], [root]
        while stack:
            for n in into.get(stack.pop(), ()):
                if n not in done:
                    done.add(n)
                    group.append(n)
                    stack.append(n)
        if len(group) > 1:
            least = min(group)
            yield from ((n, least) for n in group)


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, types = [], None
        for batch in batches:
            types = batch.schema.field(0).type
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if found := list(components_of(pairs)):
            yield pa.RecordBatch.from_arrays([pa.array(c, types) for c in zip(*found)], names=["node", "scc"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, scc {kind}")


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, scc (least node of its strongly connected component) for components of several nodes. A graph of at most `small`
    edges is walked in one task. Of a larger one, edges that no cycle can hold
    are trimmed; every node takes the least node that leads to it as its colour; nodes of a colour that lead back to it are
    its component, and leave. What is kept is a row per node and edge, and each round is written to the shared folder."""
    own = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    if own.count() <= small:
        return _in_one_task(own)
    left, n = _trimmed(own)
    found = []
    while n:
        nodes = left.select(F.col("src").alias("node")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("label")), left)
        side = lambda key, name: colours.select(F.col("node").alias(key), F.col("label").alias(name))
        within = left.join(side("src", "a"), "src").join(side("dst", "b"), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        within = stored(within, "edges")
        # a root is labelled with itself, any other node with its own name: both have the same type, and only roots spread
        back = _back(colours, within)
        found.append(back)
        rest = left.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        rest = stored(rest.select("src", "dst"), "edges")
        for used in (left, within, colours):
            forget(used)
        left, n = _trimmed(rest)
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    several = every.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").select("scc")
    return every.join(several, "scc", "left_semi").select("node", "scc")


def _back(colours: DataFrame, within: DataFrame) -> DataFrame:
    """node, scc: the roots (nodes of their own colour) and all nodes that lead to their root over edges of one colour, which
    `within` holds the other way round. The frontier alone is joined in each round."""
    reached = stored(colours.filter("node = label").select("node", F.col("label").alias("scc")), "reached")
    frontier = reached
    while True:
        new = within.join(frontier, within["src"] == frontier["node"]).select(F.col("dst").alias("node"), "scc").distinct().join(reached.select("node"), "node", "left_anti")
        new = stored(new.select("node", "scc"), "frontier")
        if new.isEmpty():
            return reached
        reached, frontier = stored(reached.unionByName(new), "reached"), new
