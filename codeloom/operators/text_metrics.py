"""Measures of lines and whole texts: style consistency, readability bands, secrets, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..detect.readability import GOOD, MEANINGLESS, MISLEADING, POINTS
from ..detect.security import PLACEHOLDERS, SECRETS


def line_consistency(lines: DataFrame) -> DataFrame:
    """Per file: lines, over 88 and 120 code points, with trailing blanks, comments, not blank, and the mean length of these."""
    n = lambda c: F.count_if(c)
    line, size = F.col("line"), F.length("line")
    return lines.groupBy("file_id").agg(
        F.count("*").alias("n_lines"), n(size > 88).alias("over_88"), n(size > 120).alias("over_120"),
        n(line.rlike("[ \\t]$")).alias("trailing"), n(line.rlike("^\\s*#")).alias("comments"), n(line.rlike("\\S")).alias("filled"),
        F.avg(F.when(line.rlike("\\S"), F.length(F.regexp_replace("line", "\\s+$", "")))).alias("mean_length"),
    )


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further one."""
    open_end = (text != "") & ~text.endswith("\n")
    return F.coalesce(_breaks(text) + open_end.cast("int"), F.lit(0)).cast("long")


def length_band(mean: Column) -> Column:
    """Score of the mean length of the lines that are not blank."""
    return F.when(mean.isNull() | mean.between(40, 80), 100).when(mean.between(30, 100), 80).when(mean.between(20, 120), 60).otherwise(40)


def density_band(comments: Column, filled: Column) -> Column:
    """Score of the share of comments in the lines that are not blank."""
    share = F.when(filled > 0, comments / filled)
    return F.when(share.isNull() | (share < 0.05), 50).when(share < 0.1, 80).when(share <= 0.2, 100).when(share <= 0.3, 70).otherwise(40)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def secrets(files: DataFrame) -> DataFrame:
    """file_id, kind, hit, line_no: all matches of the secret patterns over the whole text, each at its own place, without
    placeholders and comment lines. One projection scans the text for all patterns; a text is walked from hit to hit."""

    def after(head: Column, text: Column) -> Column:
        return F.when(text.contains("\n"), F.substring_index(text, "\n", -1)).otherwise(F.concat(head, text))

    def of_kind(kind: str, pattern: str) -> Column:
        p = f"(?i){pattern}"
        steps = F.arrays_zip(F.split("code", p, -1).alias("text"), F.regexp_extract_all("code", F.lit(p), F.lit(0)).alias("hit"))
        hit = "struct<kind:string,hit:string,line_no:int,head:string>"
        start = F.struct(F.lit(1).alias("line"), F.lit("").alias("head"), F.array().cast(f"array<{hit}>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            line, head, h = state["line"] + _breaks(x["text"]), after(state["head"], x["text"]), F.coalesce(x["hit"], F.lit(""))
            found = F.struct(F.lit(kind).alias("kind"), h.alias("hit"), line.alias("line_no"), head.alias("head"))
            return F.struct((line + _breaks(h)).alias("line"), after(head, h).alias("head"), F.when(x["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(found))).alias("out"))

        return F.when(F.col("code").rlike(p), F.aggregate(steps, start, step, lambda s: s["out"]))

    found = F.array_compact(F.array(*(of_kind(k, p) for k, p in SECRETS.items())))
    hits = files.select("file_id", F.explode(F.flatten(found)).alias("h")).select("file_id", "h.*")
    real = ~F.col("head").rlike("^\\s*#")
    for word in PLACEHOLDERS:
        real &= ~F.lower("hit").contains(word)
    return hits.filter(real).select("file_id", "kind", "hit", F.col("line_no").cast("long").alias("line_no"))


def entropy(tokens: DataFrame) -> DataFrame:
    """file_id, entropy: Shannon entropy (bits) of the tokens of each file."""
    c = tokens.groupBy("file_id", "token").agg(F.count("*").alias("c"))
    # sum of c log c and c is enough: no second pass over the tokens
    s = c.groupBy("file_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("x"))
    return s.select("file_id", (F.log2("n") - F.col("x") / F.col("n")).alias("entropy"))


def name_kind(name: Column) -> Column:
    """meaningless, misleading, good or plain; the first class with a matching pattern."""
    out = F.lit("plain")
    for kind, patterns in (("good", GOOD), ("misleading", MISLEADING), ("meaningless", MEANINGLESS)):
        out = F.when(name.rlike("|".join(f"(?:{p.pattern})" for p in patterns)), kind).otherwise(out)
    return out


def name_quality(tokens: DataFrame) -> DataFrame:
    """file_id, score: 50 and five times the mean of the points of the tokens' kinds, within 0 and 100."""
    points = F.lit(0)
    for kind, n in POINTS.items():
        points = F.when(name_kind(F.col("token")) == kind, n).otherwise(points)
    return tokens.groupBy("file_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + F.sum(points) / F.count("*") * 5)).alias("score"))
