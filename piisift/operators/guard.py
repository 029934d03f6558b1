"""User-level jobs: scrub (J2), guard (J3), hybrid guard with model answers.

All row-local projections: no shuffle except the equi-join that attaches model
answers to their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.config import MSG_INJECTION, MSG_PII, VERDICT_PARSE_ERROR_DETAILS, DetectorConfig
from piisift.functions.llm import default_verdict, findings_to_matches, llm_findings, parse_verdict
from piisift.functions.matches import empty_matches, mask_text, merge_matches, public_matches, risk_value, score_from_risk
from piisift.operators.detect import DEFAULT_CONFIG, cached_column, detect, with_candidates


def masked_column(text_col: str) -> Column:
    """The text with its merged ``matches`` replaced by ``<TYPE>``."""
    return cached_column(("masked", text_col), lambda: mask_text(F.col(text_col), F.col("matches")))


def score_column(config: DetectorConfig) -> Column:
    """The 0-100 score of the merged ``matches``."""
    key = ("score", tuple(config.weights.items()), config.default_weight)
    return cached_column(key, lambda: score_from_risk(risk_value(F.col("matches"), config.weights, config.default_weight)))


def scrub(
    df: DataFrame,
    text_col: str = "text",
    config: DetectorConfig = DEFAULT_CONFIG,
    extra_matches_col: str | None = None,
    allowlist_table: DataFrame | None = None,
) -> DataFrame:
    """``scrubbed`` (every merged span replaced by ``<TYPE>``) and ``matches``; never blocks."""
    d = detect(df, text_col, config, extra_matches_col=extra_matches_col, internal=True, allowlist_table=allowlist_table)
    return d.select(
        *[c for c in df.columns if c != extra_matches_col],
        masked_column(text_col).alias("scrubbed"),
        cached_column(("public",), lambda: public_matches(F.col("matches"))).alias("matches"),
    )


def guard(
    df: DataFrame,
    text_col: str = "text",
    config: DetectorConfig = DEFAULT_CONFIG,
    extra_matches_col: str | None = None,
    verdict_col: str | None = None,
    allowlist_table: DataFrame | None = None,
) -> DataFrame:
    """``answer, pii_score, blocked, matches, prompt_injection``.

    Blocked when the score reaches the threshold or the verdict says injection;
    the injection message wins over the PII message; otherwise the masked text.
    Without ``verdict_col`` every verdict is the "no model" default.
    """
    d = detect(df, text_col, config, extra_matches_col=extra_matches_col, internal=True, allowlist_table=allowlist_table)
    verdict = F.coalesce(F.col(verdict_col), default_verdict()) if verdict_col else default_verdict()
    keep = [c for c in df.columns if c not in (extra_matches_col, verdict_col)]
    scored = d.select(
        *keep,
        "matches",
        score_column(config).alias("pii_score"),
        verdict.alias("prompt_injection"),
    )
    injected = F.col("prompt_injection.injection_detected")
    blocked = (F.col("pii_score") >= config.block_threshold) | injected
    answer = (
        F.when(F.col(text_col).isNull(), F.lit(None).cast("string"))
        .when(injected, F.lit(MSG_INJECTION))
        .when(blocked, F.lit(MSG_PII))
        .otherwise(masked_column(text_col))
    )
    matches = cached_column(("public",), lambda: public_matches(F.col("matches")))
    if config.redact_values:
        matches = F.when(blocked, F.transform(matches, lambda m: m.withField("value", F.lit(None).cast("string")))).otherwise(matches)
    return scored.select(
        *keep,
        answer.alias("answer"),
        "pii_score",
        F.when(F.col(text_col).isNull(), F.lit(False)).otherwise(blocked).alias("blocked"),
        matches.alias("matches"),
        "prompt_injection",
    )


def parsed_answers(responses: DataFrame) -> DataFrame:
    """Each answer's ``_pii`` (findings) or ``_injection`` (verdict), with what orders it, beside the other columns.

    Order is that of the column ``answer_no`` (without it, of the answers'
    texts); verdicts that report an injection come first, those that could not
    be parsed last.  Null answers are none.
    """
    order = F.col("answer_no").cast("long") if "answer_no" in responses.columns else F.lit(0).cast("long")
    keep = [c for c in responses.columns if c not in ("task", "response", "answer_no")]
    response = F.col("response")
    given = responses.where(response.isNotNull() & F.col("task").isin("pii", "injection"))
    rows = given.select(
        *keep,
        order.alias("_n"),
        response.alias("_r"),
        F.when(F.col("task") == "pii", llm_findings(response)).alias("_f"),
        F.when(F.col("task") == "injection", parse_verdict(response)).alias("_v"),
    )
    rank = F.when(F.col("_v.injection_detected"), 0).when(F.col("_v.details") == VERDICT_PARSE_ERROR_DETAILS, 2).otherwise(1)
    pii = F.when(F.col("_f").isNotNull(), F.struct(F.col("_n").alias("n"), F.col("_r").alias("r"), F.col("_f").alias("f")))
    injection = F.when(F.col("_v").isNotNull(), F.struct(rank.alias("k"), F.col("_n").alias("n"), F.col("_r").alias("r"), F.col("_v").alias("v")))
    return rows.select(*keep, pii.alias("_pii"), injection.alias("_injection"))


def united_findings(pii: Column) -> Column:
    """The findings of all answers in an array, in their order."""
    return F.flatten(F.transform(F.array_sort(pii), lambda x: x["f"]))


def model_answers(responses: DataFrame) -> DataFrame:
    """``_doc, _findings, _best``: all answers of a text in one row, parsed before they are grouped.

    A text may have any number of answers: the findings of all are taken, and
    one that reports an injection is enough; ``_best.v`` is the verdict.
    """
    return (
        parsed_answers(responses)
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(united_findings(F.collect_list("_pii")).alias("_findings"), F.min("_injection").alias("_best"))
    )


def guard_with_answers(df: DataFrame, text_col: str = "text", config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    """J10 where a row holds its text's answers: ``_pii`` and ``_injection``, arrays of :func:`parsed_answers`' columns."""
    keep = [c for c in df.columns if c not in ("_pii", "_injection")]
    found = df.select(
        *keep,
        findings_to_matches(united_findings(F.col("_pii")), F.length(text_col)).alias("llm_matches"),
        F.array_min("_injection")["v"].alias("verdict"),
    )
    return guard(found, text_col, config, extra_matches_col="llm_matches", verdict_col="verdict")


def attach_model_answers(texts: DataFrame, responses: DataFrame, text_col: str = "text", length: Column | None = None) -> DataFrame:
    """L6 prerequisites: join raw model answers onto texts by ``doc_id``.

    Adds ``llm_matches`` (normalised findings, empty when none) and ``verdict``
    (null when no injection answer; the guard then uses the default verdict).
    ``length`` gives the texts' lengths where the rows hold no text.
    """
    joined = texts.join(model_answers(responses), F.col("doc_id") == F.col("_doc"), "left")
    size = F.length(text_col) if length is None else length
    return joined.select(
        *texts.columns,
        F.when(F.col("_findings").isNull(), empty_matches()).otherwise(findings_to_matches(F.col("_findings"), size)).alias("llm_matches"),
        F.col("_best.v").alias("verdict"),
    )


def hybrid_matches(texts: DataFrame, responses: DataFrame, text_col: str = "text", config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    """L6 without texts: ``matches`` of regex and model findings beside the other columns of ``texts``.

    Texts are searched where they are; only their candidates and lengths meet the answers.
    """
    keep = [c for c in texts.columns if c != text_col]
    thin = with_candidates(texts, text_col, config).select(*keep, F.length(text_col).alias("_length"), "_cands")
    found = attach_model_answers(thin, responses, length=F.col("_length"))
    return found.select(*keep, public_matches(merge_matches(F.concat("_cands", "llm_matches"))).alias("matches"))


def hybrid_scrub(
    texts: DataFrame, responses: DataFrame, text_col: str = "text", config: DetectorConfig = DEFAULT_CONFIG, allowlist_table: DataFrame | None = None
) -> DataFrame:
    """J2 with model findings: regex and model spans merged, then masked."""
    withllm = attach_model_answers(texts, responses, text_col).drop("verdict")
    return scrub(withllm, text_col, config, extra_matches_col="llm_matches", allowlist_table=allowlist_table)


def hybrid_guard(
    texts: DataFrame, responses: DataFrame, text_col: str = "text", config: DetectorConfig = DEFAULT_CONFIG, allowlist_table: DataFrame | None = None
) -> DataFrame:
    """Regex + model findings merged, injection verdict from the model answers."""
    withllm = attach_model_answers(texts, responses, text_col)
    return guard(withllm, text_col, config, extra_matches_col="llm_matches", verdict_col="verdict", allowlist_table=allowlist_table)
