"""Operator 12 against passing every document through every order."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from codeloom.llm import filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    failed = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any((b or "") == t and i is not None and (doc_id is None or i < doc_id) for i, b, _ in docs)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), copy)
        failed.append((source or "", doc_id, {c for c, x in zip("ABCDE", tests) if x}))
    out, shapley = [], Counter()
    for part in {f[0] for f in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in failed if p == part]
            everyone = list(left)
            for step, c in enumerate(order, 1):
                gone, left = [x for x in left if c in x[1]], [x for x in left if c not in x[1]]
                shapley[part, c] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(c in f for _, f in everyone) - len(gone), sum(f == {c} for _, f in everyone), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), c])
    return sorted(tuple([*r[:-1], shapley[r[0], r[-1]]]) for r in out)


def run(spark, docs, labels, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(i, t, None, s, None) for i, t, s in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(9) for c in ("part", "mask", "digest", "split", "own", "good", "n")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(9) for c in ("part", "good", "least")}).write.parquet(f"{d}/labels.parquet")
    return sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.op12_filter_audit(spark, d).collect())


def test_brute_force(spark, tmp_path):
    lines = [" ".join(f"w{k * j % 61}" for k in range(n)) for j, n in ((1, 49), (1, 50), (7, 80), (2, 120))]
    texts = [*lines, lines[1] + " $", lines[1].upper(), None, "", " \t\x0b\x0c", lines[2], "Ä" * 19 + "A", "Ä" * 18 + "A", "\x1cx y", "x " * 60, lines[3] + "\x85end"]
    docs = [(k * 3 % 101, texts[k % len(texts)], (None, "", "s1", "s2")[k % 4 if k % 3 else 2]) for k in range(70)]
    docs += [(5, "twice", "s1"), (5, "twice", "s2"), (None, lines[1], "s2"), (None, "alone", "s3"), (None, "alone", "s3")]
    labels = [(k, k % 2, k % 5 == 0) for k in range(0, 101, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    assert run(spark, docs, labels, tmp_path) == expected(docs, labels)


def test_no_documents_or_labels(spark, tmp_path):
    assert run(spark, [], [(1, 1, 1)], tmp_path / "a") == []
    docs = [(1, "a", None), (2, "a", "x")]
    assert run(spark, docs, [], tmp_path / "b") == expected(docs, [])


def test_prefix_weights():
    """All orders are counted once."""
    assert filter_audit._orders_with_prefix(5) == [24, 6, 4, 6, 24]
