"""Operator 5: main text of web pages.

Each page is cut into blocks of text in one pass, with what encloses them: an article, a main part, an element marked as
boilerplate (menu, footer, advert, form, comments and so on), or none of these. Pages with an article have their text from
their articles alone, other pages with a main part from that, even if it is short. The blocks of the remaining pages are one
token stream, and what a host repeats is cut from it.

That is found in a suffix array over the hosts' streams: every suffix, by its first RUN tokens, is sorted over all partitions, and
neighbours that agree in all of these and come from distinct pages are a substring that the host repeats. (A token is in a
shared substring of RUN or more tokens exactly if it is in a shared one of RUN, so the order beyond them says nothing.) Text outside
the article or main part of a page is in the array too: it has no part in that page's text, but shows what the host repeats.
Suffixes reach across blocks. A block of fewer tokens that distinct pages share as a whole goes too. Pages of a host with the same
stream are one page: mirrors keep their text. A task brings each suffix once, with its least and greatest stream, so a host with
a third of all pages is no hot key.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, in_batches, materialize, mix
from .url_filter import host_of

#: Words of a repeated run. A shorter block counts as a run of its own as well.
RUN = 8

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Content that is never text.
OPAQUE = frozenset("script style template noscript iframe object svg math canvas audio video head title select textarea".split())
BOILERPLATE = frozenset("nav header footer aside menu form button dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br td th".split())
#: Names of classes, ids or roles that mark an element as boilerplate, alone or joined with one another and with PARTS of a page.
#: In any other name (has-sidebar, related-work) they mark nothing.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices newsletter subscribe signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus share sharing social related recommended widget toolbar pagination pager search login complementary contentinfo alert".split())
PARTS = frozenset("box bar list wrapper wrap container area left right top bottom block buttons button links link section form inner outer item items thread panel slot unit group icons icon big small large sticky fixed site page global primary secondary posts articles stories posted".split())
#: Of these marks an element within a line, which may just be emphasised, says nothing
SOFT = frozenset("alert notice notices related recommended search login promotion menu overlay banner".split())
LINE = frozenset("span small mark label abbr cite code q s sub sup time u font big ins del data kbd var samp tt".split())
#: Elements that a mark does not remove, whatever their class.
UNMARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6 b i em strong a".split())
#: What starts where an open element ends without an end tag of its own, if none of WITHIN has begun in it
SIBLINGS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"}}
SIBLINGS |= {k: {"td", "th", *SIBLINGS["tr"]} for k in ("td", "th")}
WITHIN = frozenset("ul ol menu dl table select".split())
_SIZE = re.compile(r"\d+(x\d+)?")


def _attributes(text: str) -> tuple[bool, bool, bool]:
    """Whether an element is marked, is marked even within a line, and is a main part."""
    marked = hard = main = False
    for name, value in ATTRIBUTE.findall(text):
        value = value.strip("\"'").lower()
        main |= (name.lower() == "role" and value == "main") or (name.lower() == "itemprop" and value == "articlebody")
        for whole in value.split() if name.lower() != "itemprop" else ():
            words = [w for w in re.split(r"[^a-z0-9]+", whole) if w]
            if all(w in MARKS or w in PARTS or _SIZE.fullmatch(w) for w in words):
                found = MARKS.intersection(words)
                marked |= bool(found)
                hard |= bool(found - SOFT)
    return marked, hard, main


class _Open:
    """The open elements. An end tag closes the innermost element of its name, and what is open in it, but never reaches out of an
    article or a main part."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.main: list[bool] = []
        self.count: dict[str, int] = {}
        self.near: list[dict[str, int]] = [{}]  # names that are open since each article and main part began, itself included
        self.articles = self.mains = 0

    def push(self, name: str, main: bool = False) -> None:
        if name in BLOCK and self.names and self.names[-1] == "p":
            self._pop()
        self.names.append(name)
        self.main.append(main)
        if main or name == "article":
            self.near.append({})
        for count in (self.count, self.near[-1]):
            count[name] = count.get(name, 0) + 1
        self.articles += name == "article"
        self.mains += main

    def _pop(self) -> str:
        name, main = self.names.pop(), self.main.pop()
        self.count[name] -= 1
        self.near[-1][name] -= 1
        if main or name == "article":
            self.near.pop()
        self.articles -= name == "article"
        self.mains -= main
        return name

    def holds(self, name: str) -> bool:
        """Whether an end tag of the name closes anything."""
        return self.near[-1].get(name, 0) > 0

    def close(self, name: str) -> None:
        if self.holds(name):
            while self._pop() != name:
                pass

    @property
    def level(self) -> int:
        return 2 if self.articles else 1 if self.mains else 0


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, 2 in an article, 1 in a main part, 0 elsewhere) of the blocks outside boilerplate, in page order. An element that is
    removed ends with its end tag, where a sibling starts that needs none, or with the element around it. If a page has an article
    or main part only within elements that a mark, or a form, would remove, these are kept from there on."""
    out, hidden = _blocks(page, False)
    if hidden and not any(level for _, level in out):
        out, _ = _blocks(page, True)
    return out


def _blocks(page: str, lenient: bool) -> tuple[list[tuple[str, int]], bool]:
    """The blocks, and whether an article or main part is within what was removed. lenient: it ends the removal."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    around, inside = _Open(), _Open()
    skip, hidden, waived = "", False, False

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, around.level))

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            if not skip:
                parts.append(page[at:])
            break
        if not skip:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[4] is None:  # an open quote: the tag ends at the next >
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        closing = bool(m[1])
        empty = name in VOID or m[3].endswith("/")
        marked, hard, main = _attributes(m[3]) if m[3] and not closing else (False, False, False)
        main |= name == "main"
        if skip:
            if closing:
                if inside.holds(name):
                    inside.close(name)
                    if not inside.names:
                        skip = ""
                    continue
                if not around.holds(name):
                    continue
                skip = ""  # the element around it ends
            else:
                held = waived and not empty and (main or name == "article")
                hidden |= held
                if (lenient and held) or (name in SIBLINGS.get(skip, ()) and not any(inside.count.get(w) for w in WITHIN)):
                    skip = ""
                else:
                    if name in OPAQUE and name != "head":
                        end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
                        at = end.end() if end else len(page)
                    elif not empty:
                        inside.push(name, main)
                    continue
        if closing:
            if name in BLOCK:
                flush()
            around.close(name)
            continue
        if name in OPAQUE:
            end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
            flush() if name in ("title", "head") else None
            if name != "head":
                at = end.end() if end else len(page)
            continue
        removed = name in BOILERPLATE or (name not in UNMARKED and (hard if name in LINE else marked))
        if removed and not main:
            if name in BLOCK or name == "button":
                flush()
            if not empty:
                inside = _Open()
                inside.push(name)
                skip, waived = name, not around.level and (name == "form" or name not in BOILERPLATE)
            continue
        if name in BLOCK:
            flush()
        elif name in SPACE:
            parts.append(" ")
        if not empty or name == "article" or main:
            around.push(name, main)
    flush()
    return out, hidden


def _run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each place on that has as many."""
    total = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        total = mix(total + words[k : k + len(total)])
    return total


def _hashes(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the words of blocks, hashes of the stream's runs, of each block that is shorter than a run (0 for others), and of the
    whole stream."""
    stream = np.concatenate([*words, np.empty(0, np.uint64)])
    short = [_run_hashes(w, len(w))[0] if 0 < len(w) < RUN else np.uint64(0) for w in words]
    whole = mix(np.append(stream, np.uint64(len(stream))) + np.arange(len(stream) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return _run_hashes(stream, RUN).view(np.int64), np.array(short, np.uint64).view(np.int64), int(whole.astype(np.int64))


def _keys(words: list[np.ndarray]) -> list[bytes]:
    """What _hashes() hashes: the first RUN tokens of the stream's suffixes, then the tokens of each shorter block, eight bytes a token."""
    stream = np.concatenate([*words, np.empty(0, np.uint64)]).astype(">u8").tobytes()
    return [*(stream[k : k + 8 * RUN] for k in range(0, len(stream) - 8 * RUN + 1, 8)), *(w.astype(">u8").tobytes() if len(w) < RUN else b"" for w in words)]


CUT = "page_id long, url string, text string, loose array<string>, runs array<long>, short array<long>, stream long"


def cut(pages: DataFrame) -> DataFrame:
    """CUT: text is null for pages without an article or main part; of these, loose are the blocks, and runs, short, stream their
    hashes. Of others, loose are the blocks outside, and stream is theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, loose, hashes = [], [], []
                for page in part.column(2):
                    blocks = blocks_of(page.as_py() or "")
                    level = max((k for _, k in blocks), default=0)
                    texts.append("\n".join(t for t, k in blocks if k == level) if level else None)
                    loose.append([t for t, k in blocks if k < level or not level])
                    found = _hashes([hashed_words(t) for t in loose[-1]])
                    # what is outside an article is never the same page as a page without one
                    hashes.append(found if not level else ((), (), ~found[2]))
                runs, short, stream = zip(*hashes)
                lists = [pa.array(loose, pa.list_(pa.string())), *(pa.array(x, pa.list_(pa.int64())) for x in (runs, short))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), *lists, pa.array(stream, pa.int64())], names=[c.split()[0] for c in CUT.split(", ")])

    return in_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, CUT)


#: Suffixes that a task sorts out before they leave it
TOGETHER = 100_000
SUFFIXES = "host string, suffix binary, gram long, a long, b long"


def suffix_array(parsed: DataFrame) -> DataFrame:
    """SUFFIXES of the blocks of all rows, in ascending order over all partitions, equal ones in one partition: a and b are the least
    and the greatest stream that a task has found one in (of its last TOGETHER), gram its hash."""

    def rows(found: dict[tuple[str | None, bytes], list[int]]) -> pa.RecordBatch:
        hosts, keys = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*found.values()))], names=[c.split()[0] for c in SUFFIXES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str | None, bytes], list[int]] = {}
        for batch in batches:
            for host, stream, loose in zip(*batch.columns):
                host, stream, words = host.as_py(), stream.as_py(), [hashed_words(t) for t in loose.as_py()]
                runs, short, _ = _hashes(words)
                for key, gram in zip(_keys(words), (*runs.tolist(), *short.tolist())):
                    if gram:
                        old = found.get((host, key))
                        if old is None:
                            found[host, key] = [gram, stream, stream]
                        elif not old[1] <= stream <= old[2]:
                            old[1], old[2] = min(old[1], stream), max(old[2], stream)
                if len(found) >= TOGETHER:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    each = parsed.filter("size(loose) > 0").select("host", "stream", "loose").mapInArrow(run, SUFFIXES)
    return each.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix")


def repeated_in(suffixes: DataFrame) -> DataFrame:
    """host, gram of the suffixes, in order, that neighbours from distinct streams share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, said = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            # most suffixes are alone, and are passed over
            same = pc.equal(batch.column(1)[1:], batch.column(1)[:-1]).to_numpy(zero_copy_only=False)
            near = pc.not_equal(batch.column(3), batch.column(4)).to_numpy(zero_copy_only=False).copy()
            near[1:] |= same
            near[:-1] |= same
            near[[0, -1]] = True
            for host, suffix, gram, a, b in zip(*(c.to_pylist() for c in batch.filter(pa.array(near)).columns)):
                if last and last[:2] == (host, suffix):
                    a, b = min(a, last[2]), max(b, last[3])
                else:
                    said = False
                if a != b and not said:
                    out.append((host, gram))
                    said = True
                last = (host, suffix, a, b)
            if out:
                hosts, grams = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(grams, pa.int64())], names=["host", "gram"])

    return suffixes.mapInArrow(run, "host string, gram long")


def unique_runs(loose: list[str], runs: list[int], short: list[int], repeated: set[int]) -> str:
    """The blocks without the tokens that repeated runs cover and without repeated short blocks."""
    sizes = [len(hashed_words(t)) for t in loose]
    total = sum(sizes)
    edges = np.zeros(total + RUN + 1, np.int64)
    at = np.flatnonzero([r in repeated for r in runs])
    np.add.at(edges, at, 1)
    np.add.at(edges, at + RUN, -1)
    covered = np.cumsum(edges)[:total] > 0
    out, first = [], 0
    for text, n, own in zip(loose, sizes, short):
        drop = covered[first : first + n] | (own != 0 and own in repeated)
        first += n
        words = text.split()
        # white space of Unicode may cut a hashed word further: such a block stays or goes as a whole
        kept = [w for w, d in zip(words, drop.tolist()) if not d] if len(words) == n else [] if n and drop.all() else words
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html). Null or empty html has an empty text. Pages with
    equal streams on one host, and a page on another host, make no text boilerplate; equal rows have equal texts. Very long
    pages are taken whole, an empty table gives no rows."""
    # parsed once and written: both branches and the row numbers read the same rows
    parsed = materialize(cut(pages).withColumn("row", F.monotonically_increasing_id()).withColumn("host", host_of(F.col("url"))), "parsed-pages")
    sure = parsed.filter("text is not null or size(loose) = 0").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    loose = parsed.filter("text is null and size(loose) > 0")
    hashes = F.array_remove(F.array_distinct(F.concat("runs", "short")), F.lit(0).cast("long"))
    grams = loose.select("row", "host", F.explode(hashes).alias("gram"))
    covered = grams.join(repeated_in(suffix_array(parsed)), ["host", "gram"]).groupBy("row").agg(F.collect_list("gram").alias("repeated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unique_runs(r["loose"], r["runs"], r["short"], set(r["repeated"] or ())) for r in batch.select([2, 3, 4, 5]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    judged = loose.join(covered, "row", "left").select("page_id", "url", "loose", "runs", "short", "repeated").mapInArrow(run, "page_id long, url string, text string")
    out = sure.unionByName(judged)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
