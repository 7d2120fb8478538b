"""Encoding of whole texts with a public tokenizer file, at the speed of a table lookup.

A byte-level BPE splits a text before merging. Every transition from non-space to white space is such a split, and so is
every one from a letter to ASCII punctuation or a digit. So a text is cut there into chunks, the ids of each distinct
chunk come from the tokenizers library once, and a text's ids are the concatenation.

All steps but the learning work on arrays: the bytes of a group of texts are classified, cut, hashed to 64 bits and looked
up together, and the ids are gathered by offsets. Chunks with one hash are taken for the same: among 10^10 distinct chunks, two
that meet in a table of a million have one with a chance below 10^-3. The table is bounded: when it is full, chunks that
were not used since the last time are dropped. New chunks are learned together, with
line feeds between them; a line feed is a split on both sides and has an id of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import kept, span_hashes

#: Unicode's White_Space, as the tokenizer's \s has it (Python's \s holds four controls more).
_ASCII_WHITE = bytes([*range(0x09, 0x0E), 0x20])
_OTHER_WHITE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WIDE = re.compile("|".join(_OTHER_WHITE).encode())
#: Chunks that keep their ids between line feeds
SIMPLE = re.compile(f" ?[^{_ASCII_WHITE.decode()}{_OTHER_WHITE}]+")
#: A place where any text may be cut: printable ASCII before ASCII white space
_SAFE = re.compile(rb"[!-~](?=[\t-\r ])")
ENTRIES, LONGEST_KEPT = 1_000_000, 64
#: Bytes of texts that are looked up together
GROUP = 1 << 18

_OTHER, _WHITE, _LETTER, _MARK = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[list(_ASCII_WHITE)] = _WHITE
#: First bytes of the two-byte letters of U+00C0 to U+024F
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xCA] = True
#: By classes of neighbours, 4 * before + after: whether a chunk starts at the latter
_CUTS = np.zeros(16, bool)
_CUTS[[4 * _OTHER + _WHITE, 4 * _LETTER + _WHITE, 4 * _MARK + _WHITE, 4 * _LETTER + _MARK]] = True


def chunk_starts(raw: bytes, firsts: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of the texts that start at `firsts` of raw."""
    codes = np.frombuffer(raw, np.uint8)
    kind = _CLASS[codes]
    leads = np.flatnonzero(_LEADS[codes])
    if len(leads):
        lead, after = codes[leads], codes[leads + 1]
        kind[leads + 1] = np.where(((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((lead == 0xC9) & (after > 0x8F)), _OTHER, _LETTER)
    if codes.max(initial=0) >= 0xC2:
        for m in _WIDE.finditer(raw):
            kind[m.start() : m.end()] = _WHITE
    starts = np.empty(len(codes), bool)
    starts[1:] = _CUTS[(kind[:-1] << 2) | kind[1:]]
    starts[firsts[firsts < len(codes)]] = True
    return np.flatnonzero(starts)


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """The text in parts of little more than GROUP bytes, cut where chunks are cut, and whether each is the last."""
    at = 0
    while len(text) - at > GROUP and (cut := _SAFE.search(text, at + GROUP)):
        yield text[at : cut.end()], False
        at = cut.end()
    yield text[at:] if at else text, True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table:
    """Ids of chunks by hash, in a hash table with open addresses."""

    def __init__(self):
        self.n = self.end = 0  # chunks and ids in use
        self.slots, self.shift = np.full(1 << 16, -1, np.int32), np.uint64(48)
        self.keys, self.used = np.empty(0, np.uint64), np.empty(0, bool)
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each one's place, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        at = self.slots[slot]
        if self.n:
            wrong = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
                at[wrong] = now = self.slots[slot[wrong]]
                wrong = wrong[(now >= 0) & (self.keys[now] != keys[wrong])]
            self.used[at[at >= 0]] = True
        return at

    def _room(self, name: str, size: int) -> np.ndarray:
        old = getattr(self, name)
        if len(old) < size:
            new = np.zeros(max(size, len(old) * 3 // 2, 1 << 14), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def put(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """Takes in chunks, none of them here and no two equal. list() makes them be found."""
        to, counts = self.n + len(keys), np.array([len(x) for x in ids], np.int32)
        flat = np.concatenate([np.empty(0, np.uint32), *ids])
        first = self.end + np.cumsum(counts) - counts
        for name, values in (("keys", keys), ("used", np.ones(len(keys), bool)), ("first", first), ("count", counts)):
            self._room(name, to)[self.n : to] = values
        self._room("ids", self.end + len(flat))[self.end : self.end + len(flat)] = flat
        self.n, self.end = to, self.end + len(flat)

    def list(self, begin: int) -> None:
        """Enters the chunks from place `begin` on, all of them if the table has to grow."""
        while 2 * self.n > len(self.slots):
            self.slots, self.shift, begin = np.full(2 * len(self.slots), -1, np.int32), self.shift - np.uint64(1), 0
        left = np.arange(begin, self.n)
        slot = (self.keys[begin : self.n] >> self.shift).astype(np.int64)
        while len(left):
            here = slot[left - begin]
            free = self.slots[here] < 0
            self.slots[here[free]] = left[free]
            left = left[self.slots[here] != left]
            slot[left - begin] = (slot[left - begin] + 1) & (len(self.slots) - 1)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the places, one after the other."""
        counts = self.count[at].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.first[at] - (ends - counts), counts) + np.arange(total)]

    def renewed(self, most: int) -> Table:
        """A table of the chunks that were used since the last renewal, of none if these are over half of `most`."""
        stay = np.flatnonzero(self.used[: self.n])
        out = Table()
        if 0 < len(stay) <= most // 2:
            out.put(self.keys[stay], np.split(self.gather(stay), np.cumsum(self.count[stay])[:-1]))
            out.list(0)
            out.used[: out.n] = False
        return out


class Encoder:
    """ids(text): the ids of tokenizers' encode(text, add_special_tokens=False) as little-endian unsigned 32-bit values.
    Null is the empty text. Strings of special tokens are ordinary text. Texts of any length are encoded whole, long ones in
    parts of GROUP bytes and what is left to the next white space."""

    def __init__(self, path: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.entries, self.table = entries, Table()

    def _learn(self, chunks: list[str]) -> list[np.ndarray]:
        encode, feed = self.tokenizer.encode_batch_fast, self.feed
        out: list = [None] * len(chunks)
        together = [k for k, c in enumerate(chunks) if SIMPLE.fullmatch(c)] if len(feed) == 1 else []
        for at in range(0, len(together), 256):
            part = together[at : at + 256]
            ids = np.array(encode(["\n".join([chunks[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = [-1, *np.flatnonzero(ids == feed[0]).tolist(), len(ids)]
            assert len(cuts) == len(part) + 1
            for k, a, b in zip(part, cuts, cuts[1:], strict=False):
                out[k] = ids[a + 1 : b]
        alone = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(alone, encode([chunks[k] for k in alone], add_special_tokens=False) if alone else []):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """ids() of each text. Texts are looked up together, GROUP bytes or a little more at a time."""
        pieces = ((piece, last) for text in texts for piece, last in _pieces((text or "").encode()))
        group: list[tuple[bytes, bool]] = []
        size, head = 0, b""
        while True:
            piece = next(pieces, None)
            if piece:
                group.append(piece)
                size += len(piece[0])
            if size >= GROUP or not piece:
                for ids, (_, last) in zip(self._group([raw for raw, _ in group]), group):
                    if not last:
                        head += ids
                    else:
                        yield head + ids if head else ids
                        head = b""
                group, size = [], 0
            if not piece:
                return

    def _group(self, group: list[bytes]) -> list[bytes]:
        raw = b"".join(group)
        if not raw:
            return [b""] * len(group)
        if self.table.n > self.entries:
            self.table = self.table.renewed(self.entries)
        table = self.table
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in group])])
        starts = chunk_starts(raw, firsts)
        ends = np.append(starts[1:], len(raw))
        keys = span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
        at = table.places(keys)
        stays = table.n, table.end
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, index, which = np.unique(keys[new], return_index=True, return_inverse=True)
            a, b = starts[new[index]], ends[new[index]]
            order = np.argsort(b - a, kind="stable")  # long chunks last: they leave after this group
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(table.n, table.n + len(order))
            short = int(np.count_nonzero(b - a <= LONGEST_KEPT))
            ids = self._learn([raw[i:j].decode() for i, j in zip(a[order].tolist(), b[order].tolist())])
            table.put(distinct[order[:short]], ids[:short])
            table.list(stays[0])
            stays = table.n, table.end
            table.put(distinct[order[short:]], ids[short:])
            at[new] = place[which]
        ids = table.gather(at).astype("<u4", copy=False).tobytes()
        edges = np.concatenate([[0], np.cumsum(table.count[at], dtype=np.int64)])[np.searchsorted(starts, firsts)] * 4
        table.n, table.end = stays
        return [ids[i:j] for i, j in zip(edges.tolist(), edges[1:].tolist())]

    def ids(self, text: str | None) -> bytes:
        return next(self.many([text]))

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for: a byte-level piece has one character per byte."""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)


def encoder(path: str) -> Encoder:
    """One encoder per process and file; Python workers are reused, so the table outlives a task."""
    encoders = kept("encoder")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]
