import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.ctw import ContextTree, Trunk, contexts, log_kt
from codeloom.llm.lm_score import op6_lm_score, scores, stream_of


def kt(zeros, ones):
    p = 1.0
    for k in range(zeros):
        p *= (k + 0.5) / (k + 1)
    for k in range(ones):
        p *= (k + 0.5) / (zeros + k + 1)
    return p


def brute_tree(streams, depth):
    """Counts of (context, bits so far) and the weighting by recursion; gives P(byte | context)."""
    seen: dict = {}
    for s in streams:
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = seen.setdefault((tuple(s[k - d : k]), bit, s[k] >> (8 - bit)), [0, 0])
                    node[s[k] >> (7 - bit) & 1] += 1

    def weighted(context, bit, bits):
        own = kt(*seen[context, bit, bits])
        if len(context) == depth:
            return own, own
        longer = 1.0
        for b in range(256):
            if ((b, *context), bit, bits) in seen:
                longer *= weighted((b, *context), bit, bits)[0]
        return (own + longer) / 2, own

    def byte(context, b):
        total = 0.0
        for bit in range(8):
            bits, left, p = b >> (8 - bit), 1.0, 0.0
            path = [tuple(context[depth - d :]) for d in range(depth + 1)]
            path = [c for c in path if (c, bit, bits) in seen]
            for d, c in enumerate(path):
                zeros, ones = seen[c, bit, bits]
                one = (ones + 0.5) / (zeros + ones + 1)
                pw, pe = weighted(c, bit, bits)
                stop = 1.0 if d == len(path) - 1 else pe / 2 / pw
                p += left * stop * one
                left *= 1 - stop
            if not path:
                p = 0.5
            total += math.log10(p if b >> (7 - bit) & 1 else 1 - p)
        return total

    return byte


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([97, 98, 99, 200]), max_size=12), min_size=1, max_size=3))
def test_tree_is_the_recursion(rows):
    depth = 2
    streams = [[10] * depth + r + [10] for r in rows]
    keys, counts = np.unique(np.concatenate([contexts(np.array(s, np.uint8), depth) for s in streams]), return_counts=True)
    tree = ContextTree(keys, counts, depth)
    byte = brute_tree(streams, depth)
    tests = [(a, b, c) for a in (10, 97, 200, 7) for b in (97, 98) for c in (97, 200, 10, 33)]
    got = tree.log10(np.array([(a << 16) | (b << 8) | c for a, b, c in tests]))
    assert np.allclose(got, [byte((a, b), c) for a, b, c in tests], atol=1e-5)


def test_probabilities_of_all_bytes_sum_to_one():
    stream = np.frombuffer(b"\n\n\n\nabracadabra abraca\n", np.uint8)
    keys, counts = np.unique(contexts(stream, 4), return_counts=True)
    tree = ContextTree(keys, counts, 4)
    for context in (b"abra", b"zzzz", b"\n\n\n\n"):
        base = int.from_bytes(context, "big") << 8
        assert abs((10 ** tree.log10(base + np.arange(256))).sum() - 1) < 1e-6


def test_log_kt():
    z, o = np.array([0, 1, 5, 40]), np.array([0, 0, 3, 2])
    assert np.allclose(np.exp(log_kt(z, o)), [kt(a, b) for a, b in zip(z.tolist(), o.tolist())])


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(docs):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), h, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for (d, _), ws, h in zip(docs, tokens, held))


def digest(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = op6_lm_score(spark, data).collect()
    assert digest(rows) == base(docs)
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    flat = {r["doc_id"]: r["score"] for r in scores(spark.read.parquet(f"{data}/documents.parquet"), depth=0).collect()}
    assert sum(r["score"] for r in held) > 0.8 * sum(flat[r["doc_id"]] for r in held) and all(r["score"] < 0 < r["bits_per_byte"] for r in rows)


def test_odd_rows(spark):
    docs = [(1, "Aa b  aa\n"), (2, None), (3, ""), (4, " \t"), (1, "Aa b  aa\n"), (None, "é漢 b"), (6, "zz " * 9000), (9, "aa B aa")]
    assert any(zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs if d) or docs.append((16, "aa new"))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int")
    for most, capacity in ((250_000, 4_000_000), (0, 4_000_000), (2, 30)):
        rows = scores(df, most=most, capacity=capacity).collect()
        assert digest(rows) == base(docs)
        by = {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows}
        assert by[2, 1] == by[3, 1] == by[4, 1] and abs(by[1, 4] - by[9, 4]) < 1e-9
    assert scores(df.limit(0)).count() == 0
    out = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2)
    alone = scores(spark.createDataFrame([(out, "ab")], "doc_id long, text string")).first()
    assert alone["train_tokens"] == 0 and abs(alone["bits_per_byte"] - 8) < 1e-9


def test_full_depth_whatever_is_broadcast(spark, data):
    """Every row's score is the whole tree's at full depth; a small capacity changes only where contexts are looked up."""
    df = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = [contexts(stream_of(t, 6), 6) for _, t in docs]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    assert any(held)
    tree = ContextTree(*np.unique(np.concatenate([x for x, h in zip(found, held) if not h]), return_counts=True), 6)
    want = sorted((d, tree.log10(x).sum()) for (d, _), x in zip(docs, found))
    for capacity in (1_600_000, 500, 0):
        got = sorted((r["doc_id"], r["score"]) for r in scores(spark.createDataFrame(docs, "doc_id long, text string"), capacity=capacity).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9, atol=1e-6)


def test_no_byte_is_impossible_after_many_equal_ones():
    """Contexts that were seen very often, always before the same byte."""
    keys = np.sort(np.array([(a << 8 | b) << 8 | 255 for a in (97, 98) for b in (97, 98)]))
    counts = np.full(4, 1 << 28)
    tree = ContextTree(keys, counts, 2)
    trunk = Trunk(1, Trunk.weights(keys, counts, 1, 2))
    asked = np.array([(97 << 8 | 98) << 8, (97 << 8 | 98) << 8 | 127, 7])
    for got in (tree.log10(asked), trunk.log10(keys, counts, asked, 2)):
        assert np.isfinite(got).all() and (got < -8).all()
