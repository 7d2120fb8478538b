import random
import re

import pytest

from codeloom.llm.html_text import blocks_of, main_text, op5_html_text
from codeloom.llm.url_filter import filter_urls, mine, op4_url_filter

RULES = [("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def listed(url):
    host, path = split(url)
    fits = [(len(t), t, v) for t, h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def items(url):
    host, path = split(url)
    out = {f"h:{x}" for x in host.split(".") if x} | {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return out | {f"q:{x}" for x in re.findall(r"[?&]([^=&#]+)=", url or "")}


def brute(urls):
    """The verdicts by counting every combination of up to three tokens."""
    from itertools import combinations

    known = [(items(u), listed(u)[1]) for u in urls if listed(u)[0]]
    count, own = {}, {}
    for its, v in known:
        for n in (1, 2, 3):
            for c in combinations(sorted(its), n):
                count[c] = count.get(c, 0) + 1
                own[c, v] = own.get((c, v), 0) + 1
    rules = {(c, v): (k / count[c], k / len(known)) for (c, v), k in own.items() if k >= 0.01 * len(known) and k / count[c] >= 0.9}
    kept = {(c, v): x for (c, v), x in rules.items() if not any(d < set(c) and w == v and y[0] >= x[0] for (d, w), y in ((((set(d), w)), y) for (d, w), y in rules.items()))}
    out = []
    for u in urls:
        text, verdict = listed(u)
        if not text:
            its = items(u)
            best = [(conf, sup, len(c), v) for (c, v), (conf, sup) in kept.items() if set(c) <= its]
            verdict = max(best)[3] if best else "allow"
        out.append((*split(u), text, verdict))
    return out


def test_url_query(spark):
    data = "/root/testdata/sf0.01"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    want = {p: x for (p, _), x in zip(pages, brute([u for _, u in pages]))}
    got = {r["page_id"]: tuple(r)[1:] for r in op4_url_filter(spark, data).collect()}
    assert got == want and {v for *_, v in got.values()} == {"allow", "block"}


def test_a_rule_of_four_tokens_decides(spark):
    """Only all four tokens together mean block; any three of them are allowed as often."""
    import itertools

    from codeloom.llm.url_filter import judge

    four = ["h:a", "h:b", "p:c", "p:d"]
    rows = [(four, "block")] * 20 + [(list(t), "allow") for t in itertools.combinations(four, 3)] * 20
    rules = mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    got = judge(spark.createDataFrame([(1, [*four, "p:e"])], "key long, tokens array<string>"), rules).collect()
    assert [tuple(r) for r in got] == [(1, "block")]


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET?x=1", "http://a.net", "http://net/", "x://y://z.org/fr/1", "http://EXAMPLE.com/de/", "http://notexample.com/de/", "http://www.example.net/en/a?b=c#d", "http://É.org/fr/", "http://h.net#/", "http://q.net/" + "a/" * 3000]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in filter_urls(df.unionByName(df)).collect()}
    assert got == {k: (*split(u), listed(u)[0]) for k, u in enumerate(urls)}
    assert filter_urls(df.limit(0)).count() == 0
    assert filter_urls(df.filter("page_id < 3")).select("verdict").distinct().collect()[0][0] == "allow"


def test_rules_that_a_shorter_one_contains_go(spark):
    rows = [(["a", "b"], "block")] * 5 + [(["c", "d"], "allow")] * 4 + [(["c", "e"], "block")] * 4
    got = {(tuple(r["items"]), r["verdict"]) for r in mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert got == {(("a",), "block"), (("b",), "block"), (("d",), "allow"), (("e",), "block")}


def text(page):
    return [t for t, k in blocks_of(page) if k == 2]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T &lt;</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav>
    <header><h1>Site</h1></header><div class="ad big">Buy</div><article class="post"><h1>A &amp; B</h1><script>var t="</article>"</script>
    <p class=lead>One <b>two</b><br>three&nbsp;&eacute;<p>Four<!-- no <p> --> five<div class="cookie-notice"><div>x</div><p>y</p></div>
    <ul><li>item<li>item 2</ul><aside>side <p>more</p></aside><form><p>mail <input name="a"></form><blockquote>q</blockquote>
    <section id="comments"><article>bad</article></section><table><tr><td>c1<td>c2</table>tail</article><footer>&copy; me</footer>"""
    assert text(page) == ["A & B", "One two three é", "Four five", "item", "item 2", "q", "c1 c2", "tail"]


KEPT = {
    # names that only hold a mark's word remove nothing, nor does a mark on what holds the article
    '<div id="page" class="site has-sidebar"><article><p>Main text.</p></article></div>': ["Main text."],
    '<div class="no-sidebar with-comments search-results social-policy"><article><p>Main text.</p></article></div>': ["Main text."],
    '<div class="search"><div><article><p>Main text.</p></article></div></div>': ["Main text."],
    '<form id="all"><article><p>Main text.</p></article></form>': ["Main text."],
    '<div class="sidebar"><article>Teaser</article></div><article><p>Main text.</p></article>': ["Main text."],
    '<article><section class="related-work"><p>Others.</p></section><section class="search-algorithms">Sorts.</section></article>': ["Others.", "Sorts."],
    '<article><p>One <span class="alert">important</span> word <span class="ad">buy</span>.</p></article>': ["One important word ."],
    # end tags that may be left out
    '<article><ul><li class="share">Share<li>item</ul><p>Main text.</p></article>': ["item", "Main text."],
    '<article><ul><li class="share"><ul><li>a<li>b</ul>c<li>item</ul><p>Main text.</p></article>': ["item", "Main text."],
    '<article><dl><dt class="menu">M<dd>def<dt>T</dl><p>Main text.</p></article>': ["def", "T", "Main text."],
    '<article><table><tr class="ad"><td>x<tr><td>y<td class="ad">z<td>w</table>Main text.</article>': ["y w", "Main text."],
    '<article><p class="ad">Buy<p>Main text.</article>': ["Main text."],
    # what is not closed ends with what is around it
    '<article><p>First.</p><div class="ad">Buy <b>now</article><p>out</p><article><p>Second.</p></article>': ["First.", "Second."],
    '<article><p>First <span class="share">tell</p><p>Second.</p></article>': ["First", "Second."],
    '<article><div class="ad">Buy<div>more</div>and</div><p>Main text.</p></article>': ["Main text."],
    '<article><p>First.</p></div></section><p>Second.</p></article>': ["First.", "Second."],
    '<div><article><p>First.</div><p>Second.</p></article></div>': ["First.", "Second."],
    # whole names, alone and joined
    '<article><div class="cookie-notice">c</div><div class="x ad_300x250">a</div><div id="comments-section">b</div><div class="share-buttons">s</div><p>Main text.</article>': ["Main text."],
    '<article>One<textarea>typed <p></textarea> two</article>': ["One two"],
    '<article>One<div class="ad"><textarea></div></textarea>x</div> two</article>': ["One", "two"],
}


@pytest.mark.parametrize("page", KEPT)
def test_articles_are_not_lost(page):
    assert text(page) == KEPT[page]


def test_main_part_in_a_marked_element():
    assert blocks_of('<div class="overlay"><p>x</p><div role="main"><p>Main text.</p></div></div>') == [("Main text.", 1)]
    assert blocks_of('<main><div class="ad"><article>buy</article></div><p>Main text.</p></main>') == [("Main text.", 1)]


def test_many_open_elements():
    """Neither deep nor unclosed nor unopened elements cost more than their number."""
    import time

    began = time.time()
    for page in ("<article>" + "<div>" * 60_000 + "x", "<article>" + "<b>" * 60_000 + "</i>" * 60_000 + "x", "<article>x" + "</p>" * 100_000, "<article>x<div class=ad>" + "<p>" * 60_000 + "</b>" * 60_000, "<section><article>" + "<b>" * 60_000 + "</section>" * 60_000 + "x"):
        assert text(page) == ["x"]
    assert time.time() - began < 20


@pytest.mark.parametrize("page", ["<article><p>one<p>two <a href='/x", "<article>one<br/><p>two<", "<ARTICLE><P>one</P>two</ARTICLE>", "<article>one<p>two<script>x</article>"])
def test_broken_pages(page):
    got = text(page)
    assert got[0] == "one" and got[1].startswith("two")


def test_page_query(spark, data):
    rows = op5_html_text(spark, data).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = [" ".join(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", b).replace("&amp;", "&").replace("&quot;", '"').split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"].replace("&amp", "&") == "\n".join(b for b in want if b).replace("&amp", "&") and r["n_chars"] == len(r["text"])


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    bar = "Read all our terms and conditions before you go on"
    own = ["first page has a long text of its own with many words", "second page tells of something else and is just as long as that"]
    rows = [(k, f"http://h.org/{k}", f"<body><div>{bar}</div><div>{t}</div><div>menu x</div></body>", 1) for k, t in enumerate(own)]
    rows += [(5, "http://other.org/", f"<div>{bar}</div>", 1), (6, None, None, 1), (7, "u", "", 1), (8, "http://h.org/8", "<main><p>m</p></main>z", 1), (None, "http://h.org/9", f"<div>{bar} now</div>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got == {0: own[0], 1: own[1], 5: bar, 6: "", 7: "", 8: "m", None: "now"}
    assert main_text(df.limit(0)).count() == 0 and main_text(df.unionByName(df)).count() == 14


def test_mirrors_keep_their_text(spark):
    text_ = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "http://h.org/a", f"<div>{text_}</div>"), (2, "http://h.org/a?print=1", f"<div>{text_}</div>"), (3, "http://h.org/b", "<div>other</div>")]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: text_, 2: text_, 3: "other"}


def brute_unique(pages):
    """By comparing every run of every page with all runs of every page of the host that reads otherwise."""
    out = {}
    for page, (host, blocks) in pages.items():
        words = [w for b in blocks for w in b.split()]
        others = [b for h, b in pages.values() if h == host and [w for x in b for w in x.split()] != words]
        runs = {tuple(w[k : k + 8]) for b in others for w in [[v for x in b for v in x.split()]] for k in range(len(w) - 7)}
        short = {tuple(x.split()) for b in others for x in b if len(x.split()) < 8}
        covered = {k + j for k in range(len(words) - 7) if tuple(words[k : k + 8]) in runs for j in range(8)}
        kept, at = [], 0
        for b in blocks:
            own = b.split()
            left = [] if tuple(own) in short else [w for k, w in enumerate(own, at) if k not in covered]
            at += len(own)
            if left:
                kept.append(" ".join(left))
        out[page] = "\n".join(kept)
    return out


def test_what_hosts_repeat_against_brute_force(spark):
    rng = random.Random(9)
    passages = [[f"{c}{k}" for k in range(14)] for c in "abcde"]
    pages = {}
    for page in range(120):
        blocks = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.5 else [f"u{rng.randrange(4000)}" for _ in range(rng.randrange(1, 12))]
            cut_at = rng.randrange(len(words) + 1)  # a passage may reach over two blocks
            blocks += [" ".join(x) for x in (words[:cut_at], words[cut_at:]) if x]
        pages[page] = (f"h{rng.randrange(3)}.org", blocks)
    pages[200] = pages[0]
    rows = [(k, f"http://{host}/{k}", "".join(f"<div>{b}</div>" for b in blocks)) for k, (host, blocks) in pages.items()]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_unique(pages)


def test_suffixes_are_sorted_over_all_partitions(spark):
    """Those of all pages: of one with an article, what stands outside of it."""
    from codeloom.llm.html_text import cut, repeated_in, suffix_array
    from codeloom.llm.url_filter import host_of

    rng = random.Random(4)
    pages = [(k, f"http://h{k % 2}.org/{k}", "".join(f"<div>{' '.join(rng.choice('abc') for _ in range(12))}</div>" for _ in range(3))) for k in range(40)]
    pages += [(40, "http://h0.org/", "<p>" + " ".join(f"o{k}" for k in range(9)) + "</p><article>its own</article>")]
    parsed = cut(spark.createDataFrame(pages, "page_id long, url string, html string")).withColumn("host", host_of("url"))
    order = suffix_array(parsed)
    got = [(r["host"], r["suffix"]) for part in order.rdd.glom().collect() for r in part]
    assert got == sorted(got) and len(set(got)) > 1_000 and len({h for h, s in got if len(s) == 64}) == 2
    words = {k: re.findall("[a-z][0-9]*", re.sub("<article>.*|<.*?>", " ", page)) for k, _, page in pages}
    runs = {(k % 2, tuple(w[i : i + 8])) for k, w in words.items() for i in range(len(w) - 7)}
    assert len({x for x in got if len(x[1]) == 64}) == len(runs)
    shared = [sum(k % 2 == host and any(tuple(w[i : i + 8]) == run for i in range(len(w) - 7)) for k, w in words.items()) > 1 for host, run in runs]
    assert repeated_in(order).count() == sum(shared)


def test_text_outside_articles_shows_what_a_host_repeats(spark):
    bar = "Read all our terms and conditions before you go on"
    own = "a page has a long text of its own with many words"
    rows = [(1, "http://h.org/1", f"<div>{bar}</div><div>{own}</div>"), (2, "http://h.org/2", f"<div>{bar}</div><article><p>Main: {own}</p></article>"), (3, "http://i.org/", f"<div>{bar}</div>")]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: own, 2: f"Main: {own}", 3: bar}
