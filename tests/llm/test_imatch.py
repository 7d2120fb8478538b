import hashlib
import random
import struct

import pytest
import xxhash

from codeloom.llm.imatch import COARSE, COORDS, EMPTY, FINE, HALF, fingerprints, op8_imatch


def edits(docs):
    """(doc_id, text) in ascending order -> edited text."""
    out = []
    for k, (_, text) in enumerate(docs):
        half = len(text) // 2
        out.append(text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half])
    return out


def test_query(spark, data):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op8_imatch(spark, data).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for (doc, text), edited in zip(docs, edits(docs)):
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    mean = lambda k: sum(r[k] for r in rows.values()) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.1
    for k, (doc, _) in enumerate(docs):
        a, b = rows[doc]["fingerprint"], rows[docs[(k + 1) % len(docs)][0]]["fingerprint"]
        cut = lambda s: [s[i : i + 4] for i in range(0, 256, 4)]
        both = [(x, y) for x, y in zip(cut(a), cut(b)) if (x, y) != ("----", "----")]
        assert abs(rows[doc]["near_next"] - sum(x == y for x, y in both) / len(both)) < 1e-12


def test_odd_rows(spark):
    docs = [(1, "Ab cd"), (2, None), (3, ""), (4, "漢字é ab"), (9, "ab " * 20_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, next string")
    got = {r["doc_id"]: r for r in fingerprints(df).collect()}
    for (doc, text), edited in zip(docs, edits([(d, t or "") for d, t in docs])):
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[doc]["n_chars"] == len(text or "")
    assert got[2]["fingerprint"] == got[3]["fingerprint"] != got[1]["fingerprint"]
    more = df.unionByName(df).unionByName(spark.createDataFrame([(None, "Ab cd", "x")], df.schema))
    rows = fingerprints(more).collect()
    assert len(rows) == 11
    assert {(r["doc_id"], r["edited_sha256"]) for r in rows if r["doc_id"]} == {(d, r["edited_sha256"]) for d, r in got.items()}
    alone = [r for r in rows if r["doc_id"] is None][0]
    assert alone["near_next"] == 0 and alone["edited_sha256"] == hashlib.sha256(b"Ab ").hexdigest()
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("doc_id = 1")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"Ab Ab").hexdigest() and one["near_next"] == 1


def alike(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 256, 4)]
    filled = [p for p in pairs if p != ("----", "----")]
    return sum(x == y for x, y in filled) / len(filled)


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def prints(spark, docs, **band):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    return [r["fingerprint"] for r in sorted(fingerprints(df, **band).collect(), key=lambda r: r["doc_id"])]


def test_copies_keep_their_terms(spark):
    """Half of the rows are copies of one text; its terms stay in the band, and a near copy is like it."""
    text, others = words("c", 120), [words(f"o{k}x", 40) for k in range(20)]
    got = prints(spark, [text] * 20 + [text[:-1] + ["new"]] + others)
    assert len(set(got[:20])) == 1 and alike(got[0], got[20]) > 0.8


def test_near_copies_above_the_band(spark):
    """Near copies are most of the distinct texts, so that none of their shared terms is in the band."""
    text, others = words("c", 120), [words(f"o{k}x", 40) for k in range(4)]
    got = prints(spark, [text[:k] + [f"new{k}"] + text[k + 1 :] for k in range(20)] + others)
    assert all(alike(got[0], x) > 0.5 for x in got[1:20])


def test_texts_without_a_term_in_the_band(spark):
    """Rare vocabulary and short texts: an edit leaves the other coordinates as they are."""
    rare, short = words("r", 60), words("s", 3)
    common = [words("c", 30) + words(f"o{k}x", 5) for k in range(20)]
    got = prints(spark, [rare, rare[:-1] + ["new"], short, short[:-1] + ["t"]] + common, least=0.2)
    assert alike(got[0], got[1]) > 0.8 and alike(got[0], got[4]) < 0.1
    assert alike(got[2], got[3]) >= 0.2


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(docs, least=0.005, most=0.3):
    """fingerprint, edited_fingerprint of each (doc_id, text) in ascending order, term by term."""

    def drawn(text):
        out = set()
        for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" "):
            h = h64(w.encode())
            if w and (k := h >> 50 & (COARSE - 1)) < HALF:
                out.add(k << 48 | h & (1 << 48) - 1)
            if w and (k := h >> 36 & (FINE - 1)) < HALF:
                out.add(k + HALF << 48 | h & (1 << 48) - 1)
        return out

    texts = {t or "" for _, t in docs}
    df = {}
    for t in texts:
        for e in drawn(t):
            df[e] = df.get(e, 0) + 1
    lexicon = {e for e, n in df.items() if max(2, least * len(texts)) <= n <= most * len(texts)}

    def digits(h):
        return f"{h % 65536:04x}"

    def printed(text):
        own = drawn(text)
        within = own & lexicon
        banded = {e >> 48 for e in within}
        terms = within | {min(e for e in own if e >> 48 == k) for k in {e >> 48 for e in own} - banded}
        if not own:
            words = {h64(w.encode()) for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w}
            terms = {(signed(h) >> 48) % COORDS << 48 | h & (1 << 48) - 1 for h in words}
        if not terms:
            return digits(h64(text.encode())) + EMPTY * (COORDS - 1)
        out = []
        for k in range(COORDS):
            seed = 42
            mine = sorted(e for e in terms if e >> 48 == k)
            for e in mine:
                seed = h64(struct.pack("<q", e), seed)
            out.append(digits(seed) if mine else EMPTY)
        return "".join(out)

    own = [(d, t or "") for d, t in docs]
    return [(printed(t), printed(e)) for (_, t), e in zip(own, edits(own))]


@pytest.mark.parametrize("literal_rows", [200_000, 0])
def test_every_coordinate_against_brute_force(spark, literal_rows):
    rng = random.Random(8)
    vocabulary = [f"{c}{k}" for c in "aÉzQ" for k in range(400)]
    docs = [(k, None if k == 3 else rng.choice(" \t\n").join(rng.choice(vocabulary[: rng.choice((60, 600, 1600))]) for _ in range(rng.choice((0, 1, 4, 60, 500))))) for k in range(90)]
    docs += [(90 + k, docs[7][1]) for k in range(12)] + [(200, "   ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["fingerprint"], r["edited_fingerprint"]) for r in sorted(fingerprints(df, literal_rows=literal_rows).collect(), key=lambda r: r["doc_id"])]
    assert got == brute(docs)


def test_book_length_texts(spark):
    """More lexicon entries than the plan takes as a constant: the join gives what the constant gives."""
    docs = [(k, " ".join(f"w{(k * 17 + j) % 70_000}" for j in range(60_000))) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = lambda rows: sorted((r["doc_id"], r["fingerprint"], r["edited_fingerprint"]) for r in rows)
    band = {"least": 0.2, "most": 0.9}
    assert cut(fingerprints(df, literal_rows=100, **band).collect()) == cut(fingerprints(df, literal_rows=10**6, **band).collect())
