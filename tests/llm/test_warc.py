"""Operator 13: exact round trips, the seek table, random access."""

import hashlib
import io
import struct
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from codeloom.llm import warc
from codeloom.llm.common import Scratch, shared_path

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "x" * 97


def expected(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        other = len(raw) >= 100 and ids and (page_id is None or page_id > min(ids))
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", min(ids) if other else None))
    return sorted(out, key=repr)


def run(spark, pages, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame(pages, PAGES).repartition(3).withColumns({c: F.lit(1) for c in ("digest", "revisit", "first", "frame")}).write.parquet(f"{d}/pages.parquet")
    got = warc.op13_warc_bundles(spark, d)
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=repr)


ROWS = [(k, f"http://h/{k}", f"<p>{k % 7}</p>" * (20 + k % 7)) for k in range(60)] + [
    (100, None, None), (101, "", ""), (102, "http://a b/\r\nX: y\x7fä", LONG), (103, "u", LONG), (104, "u", LONG[:-1]), (105, "u", LONG[:-1]), (99, "u", "WARC/1.1\r\n\r\n" * 20),
    (106, "u", "ä" * 50), (106, "u", "ä" * 50), (107, "v", "ä" * 50), (None, "v", "ä" * 50), (None, "w", "alone" * 30), (None, "w", "alone" * 30), (108, "z", "long \x00\r\n\r\n" * 40_000), (109, "z", "long \x00\r\n\r\n" * 40_000),
]


def test_round_trip(spark, tmp_path):
    assert run(spark, ROWS, tmp_path) == expected(ROWS)


def test_none(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.fixture
def archive(spark):
    scratch = Scratch(spark, "warc-test")
    index = warc.write_bundles(spark.createDataFrame(ROWS, PAGES).repartition(2), shared_path(spark, "bundles-test"), scratch, frame_bytes=2_000, bundle_bytes=20_000)
    yield index
    scratch.drop()


def test_random_access(spark, archive):
    """Any record is reached by its identifier, a revisit through its response."""
    scratch = Scratch(spark, "warc-fetch")
    wanted = archive.filter("page_id % 3 = 0")
    got = sorted((r[0], bytes(r[1])) for r in warc.fetch(archive, wanted, scratch).collect())
    scratch.drop()
    assert got == sorted((i, (h or "").encode()) for i, _, h in ROWS if i is not None and i % 3 == 0)


def test_fields(spark, archive):
    rows = {r.page_id: r for r in warc.read_bundles(archive).collect()}
    assert (rows[100].url, rows[101].url, rows[102].url) == (None, "", "http://a%20b/%0D%0AX:%20y%7Fä")
    assert len(rows) == len({i for i, _, _ in ROWS})


def test_bundles_are_plain_zstandard(archive):
    """A reader that knows no seek table gets all records; the table has the frames' places; a damaged frame is noticed."""
    bundles = [r[0] for r in archive.select("bundle").distinct().collect()]
    assert len(bundles) > 3
    n = 0
    for path in bundles:
        raw = open(path.removeprefix("file:"), "rb").read() if not path.startswith("file://") else open(path.removeprefix("file://"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        n += len(list(warc.parsed(plain)))
        frames, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        head = struct.unpack_from("<II", raw, len(raw) - 9 - 12 * frames - 8)
        assert head == (0x184D2A5E, 12 * frames + 9)
        with warc.Bundle(path) as bundle:
            assert b"".join(bundle.frame(k) for k in range(frames)) == plain
            at, packed, size, checksum = bundle.frames[-1]
            bundle.frames[-1] = (at, packed, size, checksum ^ 1)
            with pytest.raises(ValueError):
                bundle.frame(frames - 1)
    assert n == len(ROWS)
