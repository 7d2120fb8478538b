"""JSON out of free text: direct, fenced, between braces, repaired; null if nothing parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(text: Column) -> Column:
    """Single quotes doubled, trailing commas dropped, bare keys quoted."""
    out = F.regexp_replace(text, "'", '"')
    out = F.regexp_replace(out, ",\\s*([}\\]])", "$1")
    return F.regexp_replace(out, "([{,]\\s*)([A-Za-z_]+)\\s*:", '$1"$2":')


def extract(text: Column) -> Column:
    """The first candidate that is valid JSON."""
    inner = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    braces = inner("(?s)(\\{.*\\})")
    tries = [text, inner("(?s)```json\\s*(.*?)```"), inner("(?s)```\\s*(.*?)```"), braces, repaired(braces)]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in tries))


def score(json: Column, keys: tuple[str, ...], low: float = 0, high: float = 100) -> Column:
    """The first of the keys that holds a number within the limits."""
    values = [F.get_json_object(json, f"$.{k}").cast("double") for k in keys]
    return F.coalesce(*(F.when(v.between(low, high), v) for v in values))
