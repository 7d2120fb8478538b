"""Operator 11 against a tree that is built whole, in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import merkle
from codeloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(d, text):
    return H("".join(map(field, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))


def whole(leaves):
    """The root and each leaf's siblings, level by level."""
    paths, spans, nodes = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(k, min(k + 16, len(nodes))) for k in range(0, len(nodes), 16)]
        for run in runs:
            for j in run:
                for k in spans[j]:
                    paths[k].append(("".join(nodes[i] for i in run if i < j), "".join(nodes[i] for i in run if i > j)))
        nodes, spans = [H("".join(nodes[i] for i in run)) for run in runs], [[k for j in run for k in spans[j]] for run in runs]
    return nodes[0], paths


def expected(docs):
    """The rows of op11 for documents with unique doc_ids."""
    groups, out = defaultdict(list), []
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        groups[d["source"]].append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: whole([leaf_of(d, d["text"]) for d in groups[s]]) for s in names}
    root, outer = whole([inner[s][0] for s in names]) if names else ("", [])
    for s, over in zip(names, outer):
        for d, path in zip(groups[s], inner[s][1]):
            changed = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"]) if changed else d["text"]
            fold = leaf_of(d, text)
            for before, after in (*path, *over):
                fold = H(before + fold + after)
            proof = H("".join(b + a for b, a in (*path, *over)))
            out.append((d["doc_id"], leaf_of(d, d["text"]), inner[s][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def run(spark, docs, tmp_path, levels=merkle.LEVELS):
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, DOCS).repartition(3).withColumn("path", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(2)).write.parquet(f"{d}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, d, levels)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr)


def docs_of(sizes):
    places = [(source, k) for source, n in sizes.items() for k in range(n)]
    return [
        {"doc_id": at * 7, "text": None if at % 11 == 0 else f"Text {at} Ä", "lang": None if k % 5 == 0 else "de", "source": source, "n_chars": None if k % 3 == 0 else k}
        for at, (source, k) in enumerate(places)
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 600])
def test_traversal(n):
    """A block emits the paths of the whole tree and never keeps more than its subtrees."""
    leaves, levels = [H(str(k)) for k in range(n)], 0
    while 16**levels < n:
        levels += 1
    assert [list(p) for p in merkle.traverse(leaves, levels)] == (whole(leaves)[1] if n else [])


def test_traversal_beyond_its_tree():
    """A block that is not alone goes up all its levels, with lone nodes where it ends early."""
    leaves = [H(str(k)) for k in range(20)]
    got = [list(p) for p in merkle.traverse(leaves, 3)]
    assert got == [[*p, ("", "")] for p in whole(leaves)[1]]


@pytest.mark.parametrize("levels", [1, merkle.LEVELS])
def test_query(spark, tmp_path, levels):
    """Small blocks make trees of several tiers; 20 sources make the upper tree two levels high."""
    sizes = {None: 3, "": 1, "ä": 40, "b": 300, "Z": 17, **{f"s{k}": 1 + k % 3 for k in range(15)}}
    docs = docs_of(sizes)
    got = run(spark, docs, tmp_path, levels)
    assert got == expected(docs)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    one = docs_of({"a": 1})
    assert run(spark, one, tmp_path / "one") == expected(one)
    assert run(spark, one, tmp_path / "again")[0][4] == H("")
    assert run(spark, [], tmp_path / "none") == []


def test_ties(spark, tmp_path):
    """Equal rows, rows of one doc_id and rows without one are all leaves, and all are proven."""
    row = {"doc_id": 1, "text": "a", "lang": "de", "source": "s", "n_chars": 1}
    docs = [row] * 40 + [row | {"text": "b"}] * 2 + [row | {"doc_id": None, "text": ""}] * 2
    got = run(spark, docs, tmp_path)
    assert len(got) == 44 and all(r[-1] for r in got)
    ordered = [leaf_of(d, d["text"]) for d in docs if d["doc_id"] is None] + sorted(leaf_of(d, d["text"]) for d in docs if d["doc_id"])
    assert {r[2] for r in got} == {whole(ordered)[0]}


def test_general_interface(spark):
    """Columns of any name pass through; a wrong leaf does not lead to the root."""
    scratch = Scratch(spark, "merkle-test")
    rows = spark.createDataFrame([(k, "t", H(str(k)), f"x{k}") for k in range(50)], "n long, tree string, digest string, path string")
    out = merkle.manifest(rows, "digest", "tree", "n", scratch)
    wrong = out.select(F.count_if(merkle.folded(F.col("row.digest"), F.col("path")) == F.col("root")), F.count_if(merkle.folded(F.sha2("row.path", 256), F.col("path")) == F.col("root")))
    assert tuple(wrong.first()) == (50, 0)
    assert sorted(r[0] for r in out.select("row.path").collect()) == sorted(f"x{k}" for k in range(50))
    scratch.drop()
