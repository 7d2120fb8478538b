"""What analyzers read out of a model's answers, which come as a table of texts (functions.jsonx makes JSON of them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys in the order in which they are read
RECOMMENDATION_KEYS = ("recommendations", "suggestions", "improvements", "action_items", "fixes", "next_steps")
ISSUE_KEYS = ("issues", "violations", "problems", "errors", "warnings", "solid_violations", "missing_edge_cases", "boundary_issues", "validation_gaps")


def _is(kind: str, variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith(kind)


def _under(variant: Column, key: str) -> Column:
    return F.try_variant_get(variant, f"$.{key}", "variant")


def recommendations(json: Column) -> Column:
    """Texts under the known keys: elements of lists that are texts or have a `text`, and single texts. No key: empty."""
    v = F.try_parse_json(json)

    def of_key(key: str) -> Column:
        value = _under(v, key)
        text = lambda x: F.when(_is("STRING", x), F.try_variant_get(x, "$", "string")).when(_is("OBJECT", x), F.try_variant_get(x, "$.text", "string"))
        listed = F.array_compact(F.transform(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), text))
        single = F.array(F.try_variant_get(value, "$", "string"))
        return F.when(_is("STRING", value), single).when(_is("ARRAY", value), listed).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of_key(k) for k in RECOMMENDATION_KEYS))


def issues(json: Column) -> Column:
    """Array of JSON objects under the known keys: a list's objects as they are, its texts as {"description": text}."""
    v = F.try_parse_json(json)

    def of_key(key: str) -> Column:
        value = _under(v, key)
        one = lambda x: F.when(_is("OBJECT", x), F.to_json(x)).when(_is("STRING", x), F.to_json(F.struct(F.try_variant_get(x, "$", "string").alias("description"))))
        return F.when(_is("ARRAY", value), F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), one))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of_key(k) for k in ISSUE_KEYS))


def valid(json: Column, required: tuple[str, ...] = (), strict: bool = False) -> Column:
    """Whether the text is a JSON object; if strict, whether all required keys are there and neither null nor empty."""
    v = F.try_parse_json(json)
    out = F.coalesce(_is("OBJECT", v), F.lit(False))
    if strict:
        for key in required:
            text = F.get_json_object(json, f"$.{key}")
            out = out & F.coalesce(~text.isin("", "[]", "{}"), F.lit(False))
    return out


def summary(json: Column) -> Column:
    """What an answer holds, in a line: its score, and how many recommendations and issues."""
    score = F.try_variant_get(F.try_parse_json(json), "$.score", "double")
    return F.concat_ws("; ", F.when(score.isNotNull(), F.format_string("score %.1f", score)), F.format_string("%d recommendations", F.size(recommendations(json))), F.format_string("%d issues", F.size(issues(json))))
