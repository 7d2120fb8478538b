import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import tokens
from codeloom.llm.common import hashed_words, shared_path, words_of
from codeloom.llm.packing import best_fit, op9_best_fit_packing, pack
from codeloom.llm.token_counts import attribute, op10_token_counts, section_token_counts
from codeloom.llm.token_output import SequenceReader, op1_token_output, read_token_files, write_token_files
from codeloom.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "   ", "a  b\n\n c\t", "x" * 5000, "# ! ##", "naïve café — “q” 漢字  z\x1c\x85y", "it's we'll 12 345,67", "one\ntwo\n", "\n\n", "<|endoftext|> tail"]


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def plain(text, end=None):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0ab'sé1!" + chr(0x2003) + chr(0x3000) + chr(0x180E) + chr(0x6F22)), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(encoder(PATH).ids(text), "<u4").tolist() == plain(text)


def test_words():
    assert words_of("Ab-cÉ\x0bd 1") == ["ab-cÉ".encode(), b"d", b"1"]
    assert words_of("Ab-cÉ_d 1", "alnum") == [b"ab", "cÉ".encode(), b"d", b"1"]
    assert words_of(None) == [] and len(hashed_words(None)) == len(hashed_words(" \n")) == 0
    one, two = hashed_words("aa Bb  cc"), hashed_words("x cc BB aa")
    assert one[0] == two[3] and one[1] == two[2] and one[2] == two[1] and len(set(one)) == 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "no id", "en"), (3, "again", "fr"), (3, "again", "fr"), (90, "word " * 3000, "en"), (95, "w " * 2047, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, path string")


def test_files_hold_every_token_in_order(spark, docs):
    manifest = write_token_files(docs, shared_path(spark, "t"), seq_len=16)
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], plain(r["text"], 2)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((str(d), len(x), crc(x)) for d, x in want)
    for m in manifest.collect():
        with pa.memory_map(m["path"].removeprefix("file://")) as f:
            table = pa.ipc.open_file(f).read_all()
        assert table.schema.field("ids").type.list_size == 16 and table.num_rows == m["n_sequences"]


def test_no_documents(spark, docs):
    none = docs.limit(0)
    assert read_token_files(write_token_files(none, shared_path(spark, "t"))).count() == 0
    assert pack(none).count() == 0 and section_token_counts(none).count() == 0


@pytest.mark.parametrize("items", [65_536, 3])
def test_pack_places_every_piece_once(docs, items):
    rows = pack(docs, items=items).collect()
    by_seq, seen = {}, []
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    want = []
    for r in docs.collect():
        ids = plain(r["text"], 0)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(str(r["doc_id"]), k, i, j - i, crc(ids[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    seen = [(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(seen) == sorted(want)


def test_residuals_of_all_partitions_meet(spark):
    """Three of four items of a third of a sequence fit together, wherever they were dealt."""
    rows = pack(spark.createDataFrame([(k, "word " * 680) for k in range(90)], "doc_id long, text string"), items=7).collect()
    lengths = {r["length"] for r in rows}
    assert len(lengths) == 1 and 3 * max(lengths) <= 2048 < 4 * max(lengths)
    assert len({r["sequence_id"] for r in rows}) <= 31


def test_pack_is_close_to_the_bound(spark, data):
    rows = pack(spark.read.parquet(f"{data}/documents.parquet")).collect()
    bound = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * bound + 1


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_fills_the_tightest_bin(lengths):
    rooms, want = [], []
    for i, x in enumerate(lengths):
        fitting = [b for b in range(len(rooms)) if rooms[b] >= x]
        if fitting:
            least = min(rooms[b] for b in fitting)
            rooms[next(b for b in fitting if rooms[b] == least)] -= x
        else:
            rooms.append(50 - x)
    got = best_fit(lengths, 50)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in got) and len(got) == len(rooms)


def test_section_counts(docs):
    rows = section_token_counts(docs).collect()
    want = {}
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        key = str(r["doc_id"])
        n, chars, sections = want.get(key, (0, 0, 0))
        want[key] = (n + len(plain(r["text"])), chars + sum(map(len, lines)), sections + len(lines))
    got = {}
    for r in rows:
        key = str(r["doc_id"])
        n, chars, sections = got.get(key, (0, 0, 0))
        got[key] = (n + r["n_tokens"], chars + r["n_chars"], sections + 1)
    assert got == want


def plain_sections(text):
    """Tokens and crossing tokens of each line: a token's bytes are counted one by one."""
    raw, e = text.encode(), TOKENIZER.encode(text, add_special_tokens=False)
    line_of = []
    for b in raw:
        line_of.append(line_of[-1] + (raw[len(line_of) - 1] == 10) if line_of else 0)
    counts = [[0, 0] for _ in range(text.count("\n") + 1)]
    at = 0
    for token in e.tokens:
        own = line_of[at : at + len(token)]
        at += len(token)
        best = max(sorted(set(own)), key=own.count)
        counts[best][0] += 1
        counts[best][1] += len(set(own)) > 1
    assert at == len(raw)
    return [tuple(c) for c in counts]


def test_every_section_against_counted_bytes(spark):
    rng = random.Random(2)
    alphabet = ["\n", "\n\n", " ", "  ", "word", "é", "漢字", "12", "it's", "\t\n", "\r\n", "!!"]
    docs = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for k in range(200)]
    rows = section_token_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["section"])):
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_crossing"]))
    assert got == {d: plain_sections(t) for d, t in docs} and any(c for x in got.values() for _, c in x)


def test_queries(spark, data):
    """The registered queries of the three operators, row by row."""
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    at, want = 0, []
    for d, t in docs:
        ids = plain(t, 2)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r[:4]) for r in op1_token_output(spark, data).collect()) == want
    pieces = {}
    for r in op9_best_fit_packing(spark, data).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d, t in docs:
        ids = plain(t, 0)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        assert sorted(pieces.pop(d)) == [(k, i, j - i, crc(ids[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    assert not pieces
    counted = {}
    for r in op10_token_counts(spark, data).collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + r["n_tokens"]
    assert counted == {d: len(plain(t)) for d, t in docs}


def test_attribution_rule():
    tokens, crossing = attribute(np.array([2, 6, 9]), np.array([0, 4, 7]))
    assert tokens.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 1]  # token 2-6 is shared 2:2, so the first has it
    tokens, _ = attribute(np.array([2, 7, 9]), np.array([0, 4, 7]))
    assert tokens.tolist() == [1, 1, 1]
    assert attribute(np.array([], int), np.array([0]))[0].tolist() == [0]


@pytest.mark.parametrize(("entries", "group"), [(1, 1), (40, 64), (1_000_000, 1 << 18)])
def test_ids_at_any_table_size(monkeypatch, entries, group):
    monkeypatch.setattr(tokens, "GROUP", group)
    enc = tokens.Encoder(PATH, entries)
    texts = [*ODD, "ab cd " * 300, "x" * 300 + " " + "yz" * 200, "été, élève; ÷a×b ǅ ɏ!ɐ!", *(f"w{i} z{i % 7}, q" for i in range(400)), *ODD]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(texts)] == [plain(t) for t in texts]
    assert not enc.table.n or enc.table.n <= entries + 5000


def test_any_sequence_of_mapped_files(spark, monkeypatch):
    from codeloom.llm import token_output

    monkeypatch.setattr(token_output, "BATCH_SEQUENCES", 4)  # of this process: a file is written here, with batches of many sizes
    rng = random.Random(9)
    ids, path = [], shared_path(spark, "t") + "/part-0.arrow"
    writer = token_output.SequenceWriter(token_output._open(path, True), 16, False)
    for d in range(60):
        ids.append([rng.randrange(50_000) for _ in range(rng.randrange(1, 150))])
        writer.add(d, np.array(ids[-1], "<u4").tobytes())
    writer.close()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    more = write_token_files(docs, shared_path(spark, "t"), seq_len=16)
    one = spark.createDataFrame([(-1, path, 60, writer.n_tokens, writer.n_sequences)], more.schema)
    reader = SequenceReader(one.unionByName(more), most=2)
    flat, places = [x for d in ids for x in d], [sum(map(len, ids[:d])) for d in range(60)]
    assert len(reader) == writer.n_sequences + sum(r["n_sequences"] for r in more.collect())
    for i in rng.sample(range(writer.n_sequences), writer.n_sequences):
        got, want = reader[i], flat[16 * i : 16 * i + 16]
        assert got["ids"].to_numpy(zero_copy_only=True).tolist() == want + [0] * (16 - len(want))
        assert got["valid"].to_pylist() == [True] * len(want) + [False] * (16 - len(want))
        assert [16 * i + k for k, s in enumerate(got["starts"].to_pylist()) if s] == [p for p in places if 16 * i <= p < 16 * i + 16]
        assert got["doc_ids"].to_pylist() == [d for d, p in enumerate(places) if 16 * i <= p < 16 * i + 16]
    assert [d for i in range(writer.n_sequences, len(reader)) for d in reader[i]["doc_ids"].to_pylist()] == list(range(len(ODD)))
    with pytest.raises(IndexError):
        reader[len(reader)]
    assert len(SequenceReader(more.limit(0))) == 0
