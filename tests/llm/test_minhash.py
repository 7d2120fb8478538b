import random
import re
from pathlib import Path

import pytest

from codeloom.llm import components as stars
from codeloom.llm.common import Scratch
from codeloom.llm.components import components
from codeloom.llm.minhash import near_duplicates, op3_minhash_dedup


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, part=85):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= part * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(docs))


def plain(df):
    return sorted(tuple(r[:4]) for r in df.collect())


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert plain(op3_minhash_dedup(spark, data)) == brute(docs)


@pytest.fixture(scope="module")
def family():
    """One group of near copies with light and heavy edits, in which the links form chains."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(160)]
    docs = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(12)}"
        docs.append((1000 - k, " ".join(words)))
    return docs


def test_large_family(spark, family):
    got = near_duplicates(spark.createDataFrame(family, "doc_id long, text string"))
    assert plain(got) == brute(family)


def test_odd_rows(spark):
    docs = [(9, "One two three"), (4, "one  TWO\nthree"), (2, None), (3, ""), (5, " \t"), (6, "a b c d e"), (7, "a b c d e f"), (8, "x " * 5000), (1, "x " * 9)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, rep string, n int")
    assert plain(near_duplicates(df)) == brute(docs)
    more = df.unionByName(df).unionByName(spark.createDataFrame([(None, "one two three", "s", 1)], df.schema))
    rows = near_duplicates(more).collect()
    assert len(rows) == 19 and [tuple(r[:4]) for r in rows if r["doc_id"] is None] == [(None, 1, None, True)]
    assert {tuple(r[:4]) for r in rows if r["doc_id"]} == set(brute(docs))
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_texts_of_unlike_sizes(spark):
    few = " ".join(f"b{k}" for k in range(80))
    docs = [(1, " ".join(f"a{k}" for k in range(4000))), (1, few), (5, few + " more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert plain(near_duplicates(df)) == brute(docs) and {r["component_id"] for r in near_duplicates(df).collect()} == {1}


@pytest.mark.parametrize("part", [80, 85])
def test_repeated_ids_against_brute_force(spark, part):
    rng = random.Random(part)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 40, 90, 700)))] for _ in range(12)]
    docs = []
    for _ in range(160):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        docs.append((rng.randrange(60), " ".join(words)))
    match = 28 if part == 85 else 24
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), part=part, match=match)
    assert plain(got) == brute(docs, part)


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def test_components_with_hubs(spark, monkeypatch):
    """Random links of which a third ends in one node, with few links and with many that make a hub."""
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(333, rng.randrange(400)) for _ in range(80)] + [(900, k) for k in range(901, 960)] + [(959, 960)] * 3
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in links)}
    pairs = spark.createDataFrame(links, "a long, b long")
    for hub in (0, 3, 30, 10_000):
        monkeypatch.setattr(stars, "LEAST_HUB", hub)
        scratch = Scratch(spark, "test")
        got = components(pairs, scratch).collect()
        assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
        scratch.drop()
    assert components(pairs.filter("a = b"), Scratch(spark, "test")).count() == 0


def test_only_the_result_stays(spark, family):
    from codeloom.sources.store import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "codeloom"
    before = set(folder.glob("*")) if folder.exists() else set()
    got = near_duplicates(spark.createDataFrame(family[:20], "doc_id long, text string"))
    left = [p.name.rpartition("-")[0] for p in folder.glob("*") if p not in before]
    assert left == ["result"] and got.count() == 20


@pytest.mark.parametrize("name", ["op3_minhash_dedup", "op7_decontamination"])
def test_queries_against_their_sql(spark, data, name):
    import duckdb

    from codeloom.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.queries()[name](spark, data), duck.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
