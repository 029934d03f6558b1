"""Model answers as data (L1-L6): fence removal, JSON parsing, normalisation.

The live model call is out of scope; its raw answers arrive as a table
``(doc_id, task, response)`` and are parsed as JSON variants.

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisift.config import (
    LLM_DEFAULT_CONFIDENCE,
    LLM_MIN_CONFIDENCE,
    VERDICT_NO_LLM_DETAILS,
    VERDICT_PARSE_ERROR_DETAILS,
)
from piisift.functions.arrays import let
from piisift.functions.matches import MATCHES_TYPE, make_match
from piisift.functions.validators import py_strip

#: Emission ordinal base for model findings (after every regex rule).
LLM_ORD_BASE = 1000

VERDICT_TYPE = T.StructType(
    [
        T.StructField("injection_detected", T.BooleanType()),
        T.StructField("attack_types", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("details", T.StringType()),
    ]
)


def strip_fences(response: Column) -> Column:
    """L1: a leading ```` ```json ```` removes every ```` ```json ```` and ```` ``` ````; a
    leading ```` ``` ```` removes every ```` ``` ````; then strip.  Otherwise unchanged."""
    fence, fence_json = "```", "```json"
    return (
        F.when(
            response.startswith(fence_json),
            py_strip(F.replace(F.replace(response, F.lit(fence_json), F.lit("")), F.lit(fence), F.lit(""))),
        )
        .when(response.startswith(fence), py_strip(F.replace(response, F.lit(fence), F.lit(""))))
        .otherwise(response)
    )


def json_object(response: Column) -> Column:
    """The answer as a variant if it is exactly one JSON object (after fence removal), else null.

    The parser stops after the first value, so the text is parsed inside
    brackets: anything that follows the object breaks the array or is a second
    element.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), strip_fences(response), F.lit("]")))
    first = F.try_variant_get(parsed, "$[0]", "variant")
    alone = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    return F.when(alone & F.schema_of_variant(first).startswith("OBJECT"), first)


def _kind(value: Column) -> Column:
    """JSON type of a variant by Spark's name (``BIGINT``, ``STRING``, ...); ``MISSING`` if there is none."""
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _is_number(kind: Column) -> Column:
    return kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")


def parse_pii_items(response: Column) -> Column:
    """L2: the ``pii_detected`` items as variants; ``[]`` when the answer is no JSON object, or holds no list of objects."""
    items = F.try_variant_get(json_object(response), "$.pii_detected", "array<variant>")
    whole = items.isNotNull() & ~F.exists(items, lambda x: ~_kind(x).startswith("OBJECT"))
    return F.when(whole, items).otherwise(F.array().cast("array<variant>"))


def llm_findings(response: Column) -> Column:
    """L3 + V5: normalised findings ``array<struct<ptype,value,s,e,confidence>>``, spans not yet checked.

    type upper-cased; defaults value '', start 0, end len(value), confidence
    0.5 for missing fields.  A field that is there with another JSON type (start
    and end: integers; confidence: a number; type and value: strings; null is
    none of them) drops its item.  Kept when type and value are non-empty and
    the confidence is above 0.3.
    """

    names = ("type", "value", "start", "end", "confidence")

    def norm(item: Column) -> Column:
        kinds = F.struct(*[_kind(F.try_variant_get(item, f"$.{n}", "variant")).alias(n) for n in names])
        return let(F.struct(kinds.alias("k"), item.alias("i")), typed)

    def typed(x: Column) -> Column:
        kinds, item = {n: x["k"][n] for n in names}, x["i"]
        good = F.lit(True)
        for n in ("type", "value"):
            good = good & kinds[n].isin("MISSING", "STRING")
        for n in ("start", "end"):
            good = good & kinds[n].isin("MISSING", "BIGINT")
        good = good & ((kinds["confidence"] == "MISSING") | _is_number(kinds["confidence"]))
        value = F.coalesce(F.try_variant_get(item, "$.value", "string"), F.lit(""))
        return F.struct(
            F.upper(F.coalesce(F.try_variant_get(item, "$.type", "string"), F.lit(""))).alias("ptype"),
            value.alias("value"),
            F.coalesce(F.try_variant_get(item, "$.start", "long"), F.lit(0)).cast("long").alias("s"),
            F.coalesce(F.try_variant_get(item, "$.end", "long"), F.length(value).cast("long")).alias("e"),
            F.coalesce(F.try_variant_get(item, "$.confidence", "double"), F.lit(LLM_DEFAULT_CONFIDENCE)).alias("confidence"),
            good.alias("good"),
        )

    found = F.transform(parse_pii_items(response), norm)
    kept = F.filter(found, lambda m: m["good"] & (m["ptype"] != "") & (m["value"] != "") & (m["confidence"] > LLM_MIN_CONFIDENCE))
    return F.transform(kept, lambda m: F.struct(*[m[n].alias(n) for n in ("ptype", "value", "s", "e", "confidence")]))


def findings_to_matches(findings: Column, length: Column) -> Column:
    """Findings of a text, in answer order, as internal match structs.

    Deviation: spans outside ``0 <= start < end <= length`` are dropped.
    """
    inside = F.filter(findings, lambda m: (m["s"] >= 0) & (m["s"] < m["e"]) & (m["e"] <= length))
    return F.transform(inside, lambda m, i: make_match(m["s"], m["e"], i + F.lit(LLM_ORD_BASE), m["ptype"], m["value"], m["confidence"], "llm")).cast(MATCHES_TYPE)


def llm_matches(response: Column, text: Column) -> Column:
    """One answer's findings as internal match structs of its text."""
    return findings_to_matches(llm_findings(response), F.length(text))


def parse_verdict(response: Column) -> Column:
    """L4: injection verdict; defaults false/[]/0.0/''; no JSON object -> ``parsing_error``.

    ``injection_detected`` counts as the caller of the reproduced service
    tests it: any non-empty string, non-zero number, non-empty list or object
    is true.
    """
    body = json_object(response)
    flag = F.try_variant_get(body, "$.injection_detected", "variant")
    kind = _kind(flag)
    truth = (
        F.when(kind == "BOOLEAN", F.try_variant_get(flag, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(flag, "$", "string") != "")
        .when(_is_number(kind), F.try_variant_get(flag, "$", "double") != 0)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(flag).isin("[]", "{}"))
        .otherwise(F.lit(False))
    )
    sure = F.try_variant_get(body, "$.confidence", "variant")
    details = F.try_variant_get(body, "$.details", "variant")
    ok = F.struct(
        F.coalesce(truth, F.lit(False)).alias("injection_detected"),
        F.coalesce(F.try_variant_get(body, "$.attack_types", "array<string>"), F.array().cast("array<string>")).alias("attack_types"),
        F.when(_is_number(_kind(sure)), F.try_variant_get(sure, "$", "double")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(_kind(details) == "STRING", F.try_variant_get(details, "$", "string")).otherwise(F.lit("")).alias("details"),
    )
    return F.when(body.isNotNull(), ok).otherwise(parse_error_verdict())


def parse_error_verdict() -> Column:
    return F.struct(
        F.lit(False).alias("injection_detected"),
        F.array().cast("array<string>").alias("attack_types"),
        F.lit(0.0).alias("confidence"),
        F.lit(VERDICT_PARSE_ERROR_DETAILS).alias("details"),
    )


def default_verdict() -> Column:
    """The verdict when no model answer exists."""
    return F.struct(
        F.lit(False).alias("injection_detected"),
        F.array().cast("array<string>").alias("attack_types"),
        F.lit(0.0).alias("confidence"),
        F.lit(VERDICT_NO_LLM_DETAILS).alias("details"),
    )
