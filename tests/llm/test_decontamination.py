import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.decontamination import decontaminate, merged, op7_decontamination, without_spans
from codeloom.llm.fmindex import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    occurs = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            occurs.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    widths = {len(x) for x in occurs}
    out = []
    for doc, text in docs:
        w = WORD.findall(low(text))
        hit, found = [False] * len(w), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in occurs:
                    hit[k : k + n] = [True] * n
                    found |= occurs[tuple(w[k : k + n])]
        out.append((str(doc), len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_fm_index_finds_what_a_scan_finds(symbols):
    text = np.array([*symbols, 0])
    index = FMIndex(text)
    assert sorted(suffix_array(text)) == list(range(len(text)))
    patterns = np.array([[a, b] for a in range(1, 5) for b in range(1, 5)])
    lows, highs = index.search(patterns)
    for p, a, b in zip(patterns, lows, highs):
        want = [k for k in range(len(text) - 1) if text[k] == p[0] and text[k + 1] == p[1]]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def digest(rows):
    return sorted((str(r["row"]["doc_id"]), r["found"]["n_words"], sum(s["last"] - s["first"] for s in r["found"]["spans"]), len(r["found"]["items"]), hashlib.sha256(",".join(r["found"]["items"]).encode()).hexdigest(), bool(r["found"]["spans"])) for r in rows)


def test_odd_rows_and_blocks(spark):
    ten = "One two, three four five six seven eight nine ten"
    docs = [(1, f"x {ten.upper()} eleven y"), (2, None), (3, ""), (4, f"{ten} {ten}"), (5, "short item here"), (5, "short item here"), (None, "a short-item b"), (7, "é漢 é漢 " * 30), (8, "one two three four five six seven eight nine")]
    items = [(1, f"{ten} eleven"), (2, ten), (2, ten), (3, "short item"), (4, None), (5, "!!"), (None, "é漢"), (6, "the end")]
    d = spark.createDataFrame([(*x, "extra", 0) for x in docs], "doc_id long, text string, found string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert digest(decontaminate(d, b).collect()) == want
    assert digest(decontaminate(d, b, block_bytes=20).collect()) == want
    assert digest(decontaminate(d, b.limit(0)).collect()) == brute(docs, [])
    assert decontaminate(d.limit(0), b).count() == 0


def test_query(spark, data):
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{data}/{t}.parquet").collect()]
    got = sorted((str(r["doc_id"]), *r[1:]) for r in op7_decontamination(spark, data).collect())
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id")) and any(r[-1] for r in got)


def test_removal():
    assert merged([(5, 8), (1, 3), (3, 4), (7, 9)]) == [(1, 4), (5, 9)]
    assert without_spans("A b, c d! e", [(1, 3)]) == "A  d! e" and without_spans(None, []) == ""
