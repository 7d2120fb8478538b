"""Operator 13: web pages as WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each of which holds whole records, about FRAME_BYTES of them, and a last,
skippable frame: the public seek table, with the compressed and the plain size of every frame and the low half of its XXH64.
So any Zstandard reader gets the plain archive, and one that knows the table reaches a record by its place: the bundle, the
number of its frame, and where in the plain frame it starts. The index of a run has these places by record identifier.

Pages with equal payloads are told by the SHA-256 of the payload; the one with the smallest page_id is a response, the others
are revisits that refer to it and carry the HTTP header alone. Pages are written by the tasks that scan them; only those of
payloads that several pages have are looked up. A task names its bundles with a random part and reports them in the index, which
Spark commits, so bundles of failed or repeated attempts are never read.

A null html is an empty payload, a null url leaves the target out. Rows that share the smallest page_id of their payload are all
responses; a row without a page_id revisits the smallest one, or is a response if there is none. Repeated rows are
written each. Control characters and spaces of a url are percent-encoded. An empty table gives no bundle. Other columns are not
read."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_batches, shared_path
from .token_output import _open

#: Plain bytes from which a frame ends, and from which a bundle does
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
#: Neighbouring frames that one opening of a bundle reads, and such runs that one task reads: places are small rows that stand
#: for much work, so the number of tasks must not follow their bytes
FRAMES_A_READ, RUNS_A_TASK = 16, 8
#: Payloads with fewer bytes are always written
LEAST_REVISIT = 100
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of its skippable frame and of its footer, and the bit that tells of checksums
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed values of the archive format
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, start int, length int"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _sink(path: str):
    """A file on any store that Arrow can reach. Arrow would pack a name that ends in .zst once more."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)


class BundleWriter:
    """Takes records one after the other; close() appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes, self.packer = sink, frame_bytes, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.pending = self.plain = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its start in the plain frame."""
        place = len(self.frames), self.pending
        self.parts.append(record)
        self.pending += len(record)
        self.plain += len(record)
        if self.pending >= self.frame_bytes:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        plain = b"".join(self.parts)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.parts, self.pending = [], 0

    def close(self) -> None:
        if self.parts:
            self._end_frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class Bundle:
    """A bundle to read from: its seek table is read once, a frame when it is asked for."""

    def __init__(self, path: str):
        self.source = _open(path, False)
        size = self.source.size()
        self.source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.source.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & CHECKSUMS else 8
        self.source.seek(size - 9 - n * width)
        entries, at = self.source.read(n * width), 0
        self.frames: list[tuple[int, int, int, int | None]] = []
        for k in range(n):
            packed, plain = struct.unpack_from("<II", entries, k * width)
            self.frames.append((at, packed, plain, struct.unpack_from("<I", entries, k * width + 8)[0] if width == 12 else None))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain, checksum = self.frames[k]
        self.source.seek(at)
        out = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(out) != plain or checksum not in (None, xxhash.xxh64_intdigest(out) & 0xFFFFFFFF):
            raise ValueError(f"frame {k} is damaged")
        return out

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode(errors="surrogatepass") for k, v in fields)
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, head, block)


def parsed(plain: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Fields, HTTP header and payload of the records from a place of a plain frame on."""
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        version, *lines = plain[at:end].split(b"\r\n")
        if version != VERSION:
            raise ValueError(f"no record at {at}")
        fields = {k.decode(): v.decode(errors="surrogatepass") for k, _, v in (line.partition(b": ") for line in lines)}
        block = plain[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 8 + len(block)
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, http, payload


def typed(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to: which pages have the payload of another one with a smaller page_id."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    narrow = pages.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", digest.alias("digest"))
    same = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    same = scratch.write(same.select("digest", "first"), "same")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.join(same, "digest", "left").select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, out: str, scratch: Scratch, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes `pages` (page_id, url, html) under `out` and returns the index: the place of every record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, rows = None, "", []
        for batch in batches:
            for page_id, url, html, digest, revisit, refers_to in zip(*(batch.column(k) for k in range(6))):
                if writer is None:
                    path = f"{out}/bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(_sink(path), frame_bytes)
                page_id, digest, revisit = page_id.as_py(), digest.as_py(), revisit.as_py()
                payload = (html.as_py() or "").encode()
                made = record(page_id, url.as_py(), payload, digest, refers_to.as_py(), revisit, date)
                frame, start = writer.add(made)
                rows.append((record_id(page_id, digest), page_id, "revisit" if revisit else "response", path, frame, start, len(made)))
                if writer.plain >= bundle_bytes:
                    writer.close()
                    writer = None
            if writer is None or len(rows) >= 20_000:
                yield _batch(rows, INDEX)
                rows = []
        if writer:
            writer.close()
        if rows:
            yield _batch(rows, INDEX)

    return scratch.write(in_batches(typed(pages, scratch)).mapInArrow(write, INDEX), "index")


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], names=list(names))


def _number(identifier: str | None) -> int | None:
    page_id = identifier.split(":")[2] if identifier else ""
    return int(page_id) if page_id else None


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of an index's bundles, run of frames after run of frames. The digest of each response is computed again from its payload; a
    revisit has it, and the payload's length, from its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with Bundle(path) as bundle:
                    for frame in range(first, last + 1):
                        yield _batch([_row(*r) for r in parsed(bundle.frame(frame))], RECORDS)

    runs = index.groupBy("bundle", F.floor(F.col("frame") / FRAMES_A_READ).alias("run")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    tasks = -(-runs.count() // RUNS_A_TASK)
    return runs.select("bundle", "first", "last").repartition(max(1, tasks), "bundle", "first").mapInArrow(read, RECORDS)


def _row(fields: dict[str, str], http: bytes, payload: bytes) -> tuple:
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    size = int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1])
    if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    return _number(fields["WARC-Record-ID"]), size, digest, kind, _number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI")


def fetch(index: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id and payload (binary) of the wanted record identifiers (column record_id): only their frames are read, each once. A
    revisit's payload is that of the response it refers to: its identifier has the same digest."""
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    own = places.filter("record_type = 'response'").select("page_id", "bundle", "frame", "start", "length")
    digest = F.split("record_id", ":")[3]
    responses = index.filter("record_type = 'response'").groupBy(digest.alias("digest")).agg(F.min_by(F.struct("bundle", "frame", "start", "length"), "page_id").alias("at"))
    others = places.filter("record_type = 'revisit'").select("page_id", digest.alias("digest")).join(responses, "digest").select("page_id", "at.*")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, plain = None, b""
        for batch in batches:
            ids, payloads = [], []
            for r in batch.to_pylist():
                if (r["bundle"], r["frame"]) != last:
                    with Bundle(r["bundle"]) as bundle:
                        last, plain = (r["bundle"], r["frame"]), bundle.frame(r["frame"])
                ids.append(r["page_id"])
                payloads.append(next(parsed(plain[r["start"] : r["start"] + r["length"]]))[2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], names=["page_id", "payload"])

    found = scratch.write(own.unionByName(others), "places")
    tasks = -(-found.select("bundle", "frame").distinct().count() // (FRAMES_A_READ * RUNS_A_TASK))
    return found.repartition(max(1, tasks), "bundle", "frame").sortWithinPartitions("bundle", "frame", "start").mapInArrow(read, "page_id long, payload binary")


def op13_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages` into bundles and back."""
    scratch = Scratch(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "bundles"), scratch)
    return scratch.last(read_bundles(index).drop("url"))
