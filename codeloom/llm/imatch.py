"""Operator 8: I-Match fingerprints over randomised lexicons. DataFrame functions only.

Terms are lower-cased words. A hash of the term draws it into none, one or two of 64 lexicons: 32 hold 1/128 of all
terms each, 32 hold 1/1024 each, the latter for long texts. Of these, the lexicons keep terms whose inverse document
frequency lies in a band. A coordinate of the fingerprint is a hash of the text's sorted distinct terms in one lexicon.

A coordinate whose drawn terms are all out of the band (too rare, or those of a large group of near copies, too frequent) is
a hash of the least of them, and a text without drawn terms has its coordinates from all its words. This is decided for
each coordinate on its own, so an edit changes those alone into whose lexicon it brings a term, or from which it takes one.

Document frequencies are counted over distinct texts, so copies do not push their terms out of the band, and for drawn
terms only. The band bounds the lexicons' size whatever the corpus: a term is in LEAST of the distinct texts at least, so
there are at most (mean distinct drawn terms of a text) / LEAST of them. Lexicons of up to LITERAL_ROWS entries are a
constant of the plan, in buckets, so that a term is looked up in one step; larger ones, as book-length texts give, are a
table that the drawn terms are joined with. Both ways give the same fingerprints.

Each document needs a piece of the next one. Ids are ranked by a range sort of ids alone; every document then sends
the wanted prefix and its fingerprint to the one before. Texts are fingerprinted and shuffled by doc_id once; both joins
read that shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_partitions, materialize

#: Band of document frequency as shares of all distinct texts; the idf band is its negated logarithm.
LEAST, MOST = 0.005, 0.3
EMPTY = "----"
#: coordinates in all; coordinates and 1/share of the coarse and the fine lexicons
COORDS, HALF, COARSE, FINE = 64, 32, 128, 1024
#: Lexicon entries (8 bytes) that go into the plan as a constant, and the most buckets they are dealt to
LITERAL_ROWS, BUCKETS = 200_000, 1 << 16
SPACES = "[\\x20\\x09-\\x0D]+"


def term_hashes(text: Column) -> Column:
    """Hashes of the words of a text, one for each occurrence. That of the empty word may be among them."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: F.xxhash64(w))


def entry(h: Column, coordinate: Column) -> Column:
    return F.shiftleft(coordinate, 48).bitwiseOR(h.bitwiseAND(F.lit((1 << 48) - 1)))


def drawn_terms(text: Column) -> Column:
    """Distinct (coordinate * 2^48 + 48 bits of hash) of the terms that are drawn into a lexicon."""
    place = lambda h, at, share: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(share - 1))
    # the place is below HALF where its upper bits are 0
    within = lambda h, at, share: h.bitwiseAND(F.lit((share - HALF) << at)) == 0
    coarse, fine = lambda h: within(h, 50, COARSE), lambda h: within(h, 36, FINE)

    def of(hashes: Column) -> Column:
        one = F.transform(F.filter(hashes, coarse), lambda h: entry(h, place(h, 50, COARSE)))
        two = F.transform(F.filter(hashes, fine), lambda h: entry(h, place(h, 36, FINE) + HALF))
        return F.concat(one, two)

    few = F.array_distinct(F.filter(term_hashes(text), lambda h: (coarse(h) | fine(h)) & (h != F.xxhash64(F.lit("")))))
    # transform() over a one-element array names the hashes, so that they are computed once
    return F.transform(F.array(few), of)[0]


def dealt_terms(text: Column) -> Column:
    """All distinct terms of a text, each dealt to one coordinate."""
    hashes = F.array_distinct(F.filter(term_hashes(text), lambda h: h != F.xxhash64(F.lit(""))))
    return F.transform(hashes, lambda h: entry(h, F.pmod(F.shiftright(h, 48), F.lit(COORDS))))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """entry: all lexicon entries within the band of distinct texts. The band's lower end is at least two of them."""
    key = (F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    n = docs.select(*key).distinct().count()
    texts = docs.select(*key, drawn_terms(F.col("text")).alias("terms")).groupBy("h1", "h2").agg(F.first("terms").alias("terms"))
    entries = texts.select(F.explode("terms").alias("entry"))
    return entries.groupBy("entry").agg(F.count("*").alias("df")).filter(F.col("df").between(max(2, least * n), most * n)).select("entry")


def literal(entries: list[int]) -> Callable[[Column], Column]:
    """From an array of drawn terms, those that are lexicon entries: each is looked for in its bucket of a constant."""
    size = min(BUCKETS, 1 << len(entries).bit_length())
    buckets: list[list[int]] = [[] for _ in range(size)]
    for e in entries:
        buckets[e & (size - 1)].append(e)
    constant = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
    return lambda drawn: F.filter(drawn, lambda t: F.array_contains(F.get(constant, t.bitwiseAND(F.lit(size - 1)).cast("int")), t))


def places() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(COORDS - 1).cast("long"))


def fingerprint(text: Column, drawn: Column, within: Callable[[Column], Column]) -> Column:
    """64 coordinates of four hexadecimal digits, `----` where the text has no term of the lexicon. drawn: the text's drawn terms;
    within: which of them are in the band. A coordinate without a term in the band has its least drawn term; a text without drawn
    terms has its coordinates from all its words. A text without words has a hash of itself as its first coordinate."""
    # transform() over one-element arrays names what follows, so that it is computed once
    named = lambda value, f: F.transform(F.array(value), f)[0]
    digits = lambda h: F.lpad(F.lower(F.hex(F.pmod(h, F.lit(65_536)))), 4, "0")

    place = lambda t: F.shiftright(t, 48)

    def chosen(drawn: Column, within: Column) -> Column:
        """drawn: sorted, so the least term of a coordinate is the one before which another coordinate ends."""
        least = F.filter(drawn, lambda t, i: (i == 0) | (place(F.get(drawn, i - 1)) != place(t)))
        rest = named(F.transform(within, place), lambda at: F.filter(least, lambda t: ~F.array_contains(at, place(t))))
        return F.when(F.size(drawn) > 0, F.concat(within, rest)).otherwise(dealt_terms(text))

    own = F.array_sort(named(F.array_sort(drawn), lambda d: named(within(d), lambda w: chosen(d, w))))

    def all_coordinates(terms: Column, at: Column, filled: Column) -> Column:
        """terms are sorted, so those of a coordinate stand together; at: the coordinate of each."""
        first = lambda k: F.array_position(at, k).cast("int")
        after = lambda i: F.coalesce(first(F.get(filled, i + 1)), F.size(terms) + 1)
        hashes = F.transform(filled, lambda k, i: digits(F.xxhash64(F.slice(terms, first(k), after(i) - first(k)))))
        both = F.struct(filled.alias("k"), hashes.alias("h"))
        return F.array_join(named(both, lambda x: F.transform(places(), lambda k: F.coalesce(F.get(x["h"], F.array_position(x["k"], k).cast("int") - 1), F.lit(EMPTY)))), "")

    def of(terms: Column) -> Column:
        at = F.transform(terms, place)
        return named(at, lambda a: named(F.array_distinct(a), lambda filled: all_coordinates(terms, a, filled)))

    whole = F.concat(digits(F.xxhash64(F.coalesce(text, F.lit("")))), F.lit(EMPTY * (COORDS - 1)))
    return named(own, lambda terms: F.when(F.size(terms) == 0, whole).otherwise(of(terms)))


def printer(entries: DataFrame, most: int = LITERAL_ROWS) -> Callable[[DataFrame, str, str], DataFrame]:
    """(df, text, name) -> df with the fingerprint of the column `text` under a name. entries: the lexicons, in a written table."""
    if entries.count() <= most:
        within = literal(sorted(r[0] for r in entries.collect()))
        return lambda df, text, name: df.withColumn(name, fingerprint(F.col(text), drawn_terms(F.col(text)), within))

    def joined(df: DataFrame, text: str, name: str) -> DataFrame:
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_drawn", drawn_terms(F.col(text))), "drawn")
        found = rows.select("_row", F.explode("_drawn").alias("entry")).join(entries, "entry").groupBy("_row").agg(F.collect_list("entry").alias("_within"))
        within = F.coalesce("_within", F.array().cast("array<bigint>"))
        return rows.join(found, "_row", "left").withColumn(name, fingerprint(F.col(text), F.col("_drawn"), lambda _: within)).drop("_row", "_drawn", "_within")

    return joined


def likeness(a: Column, b: Column) -> Column:
    """Equal coordinates as a share of those that either fingerprint has filled."""
    at = lambda s, k: F.substring(s, (k * 4 + 1).cast("int"), F.lit(4))
    # 0 where neither is filled, 2 where both have the same, else 1
    kinds = F.transform(places(), lambda k: F.when(at(a, k) == at(b, k), F.when(at(a, k) == EMPTY, 0).otherwise(2)).otherwise(1))
    filled, equal = F.filter(kinds, lambda x: x > 0), lambda x: F.size(F.filter(x, lambda y: y == 2))
    return F.coalesce(F.transform(F.array(filled), lambda x: F.when(F.size(x) > 0, equal(x) / F.size(x)))[0], F.lit(0.0))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, prev_id, prev_n: for each distinct doc_id, the one before in ascending order (for the first: the last) and the
    most code points of its texts."""
    ids = docs.groupBy("doc_id").agg(F.max("n_chars").alias("n")).filter("doc_id is not null")
    # monotonically_increasing_id numbers rows within a partition; written once, so that it stays
    dealt = ids.repartitionByRange(input_partitions(ids), "doc_id").sortWithinPartitions("doc_id")
    placed = materialize(dealt.select("doc_id", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")), "ids")
    before = placed.groupBy("part").agg(F.count("*").alias("c"))  # a row per partition
    offsets = before.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    total = max(1, placed.count())
    local = F.col("m") - F.shiftleft(F.col("part").cast("long"), 33)
    ranked = placed.join(F.broadcast(offsets), "part").select("doc_id", "n", (local + F.col("offset")).alias("rank"))
    behind = ranked.select(F.col("doc_id").alias("prev_id"), F.col("n").alias("prev_n"), F.pmod(F.col("rank") + 1, F.lit(total)).alias("rank"))
    return materialize(ranked.join(behind, "rank").select("doc_id", "prev_id", "prev_n"), "neighbours")


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST, literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, in ascending doc_id; the last one's next is the first. Null is the empty text. Of rows that repeat a
    doc_id, the document before takes the least text; all of them have the next doc_id as their next. A row without
    doc_id has no next: its edited text is its first half, its near_next 0. Texts of any length are taken whole; `literal_rows`
    decides how lexicons are looked up and does not change results."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    printed_by = printer(materialize(lexicon(own, least, most), "lexicon"), literal_rows)
    chain = neighbours(own.select("doc_id", F.length("text").cast("long").alias("n_chars")))
    half = lambda n: F.floor(n / 2).cast("int")
    # the key has no nulls: both joins then read the same columns of the same rows, so texts are shuffled and printed once
    key = lambda c: F.col(c).cast("string")
    named = own.select(F.coalesce(key("doc_id"), F.concat(F.lit("n"), F.xxhash64("text").cast("string"))).alias("key"), "text")
    printed = printed_by(named, "text", "fingerprint").repartition("key")
    chain = chain.select(F.coalesce(key("doc_id"), F.lit("")).alias("key"), F.coalesce(key("prev_id"), F.lit("")).alias("prev_key"), "prev_n")
    sent = printed.join(chain, "key", "left").select(F.coalesce("prev_key", F.concat(F.lit("none"), "key")).alias("key"), F.substring("text", F.lit(1), half(F.col("prev_n"))).alias("prefix"), F.col("fingerprint").alias("next_print"))
    sent = sent.repartition("key").groupBy("key").agg(F.min(F.struct("prefix", "next_print")).alias("next"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - half(n)), F.substring(F.coalesce("next.prefix", F.lit("")), F.lit(1), half(n)))
    out = printed.join(sent, "key", "left").select(F.expr("try_cast(key as bigint)").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.next_print").alias("next_print"))
    out = printed_by(out, "edited", "edited_fingerprint").select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_print")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), F.coalesce(near("next_print"), F.lit(0.0)).alias("near_next"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
