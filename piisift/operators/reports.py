"""Reports over detection results (J5-J9, corpus risk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.config import (
    MSG_INJECTION,
    MSG_PII,
    PAGE_SEPARATOR,
    REPORT_MAX_ENTITIES,
    REPORT_PREVIEW_CHARS,
    REPORT_PREVIEW_ELLIPSIS,
    DetectorConfig,
)
from piisift.functions.arrays import let
from piisift.functions.llm import findings_to_matches
from piisift.functions.matches import MATCH_FIELDS, mask_text, merge_matches, risk_value, score_from_risk, type_token, weight_of
from piisift.operators.detect import (
    DEFAULT_CONFIG,
    LISTED_TYPES,
    count_allowlisted,
    drop_allowlisted,
    explode_matches,
    listed_keys,
    with_candidates,
    with_listed_dropped,
)
from piisift.operators.guard import guard, hybrid_guard, model_answers
from piisift.operators.longform import merge_long
from piisift.session import checkpoint_dir
from piisift.sources.texts import PIECE_PAGES, document_pieces, piece_offsets


def top_entities(matches: Column, cap: int = REPORT_MAX_ENTITIES) -> Column:
    """J6, row form: distinct (type, value) pairs, types in first-seen order, values
    within a type in first-seen order, at most ``cap``.  No shuffle."""
    pairs = F.array_distinct(F.transform(matches, lambda m: F.struct(m["ptype"].alias("ptype"), m["value"].alias("value"))))
    types = F.array_distinct(F.transform(matches, lambda m: m["ptype"]))
    ranked = F.transform(
        pairs,
        lambda e, i: F.struct(
            F.array_position(types, e["ptype"]).alias("tpos"),
            i.alias("epos"),
            e["ptype"].alias("ptype"),
            e["value"].alias("value"),
        ),
    )
    return F.slice(F.array_sort(ranked), 1, cap)


def preview(answer: Column, n: int = REPORT_PREVIEW_CHARS) -> Column:
    return F.when(F.length(answer) > n, F.concat(F.substring(answer, 1, n), F.lit(REPORT_PREVIEW_ELLIPSIS))).otherwise(answer)


def document_report(docs: DataFrame, text_col: str = "text", config: DetectorConfig = DEFAULT_CONFIG, answers: DataFrame | None = None) -> DataFrame:
    """Guard each assembled document; score, blocked, match count, top
    entities (``array<struct<ptype,value>>``) and a 400-character preview.
    With ``answers`` (raw model answers by ``doc_id``) their findings and
    injection verdict count as in the hybrid guard."""
    g = guard(docs, text_col, config) if answers is None else hybrid_guard(docs, answers, text_col, config)
    ents = top_entities(F.col("matches"))
    return g.select(
        "doc_id",
        "pii_score",
        "blocked",
        F.size("matches").alias("total_matches"),
        F.transform(ents, lambda e: F.struct(e["ptype"].alias("ptype"), e["value"].alias("value"))).alias("entities"),
        preview(F.col("answer")).alias("preview"),
    )


def _leading(entities: Column) -> Column:
    """Distinct entities by type, types and values as first seen, at most ``REPORT_MAX_ENTITIES`` of a type.

    More of one type than that cannot be in a report; all types stay, since an
    earlier part of the document may bring one forward.
    """

    def by_type(listed: Column) -> Column:
        types = F.array_distinct(F.transform(listed, lambda e: e["ptype"]))
        return F.flatten(F.transform(types, lambda t: F.slice(F.filter(listed, lambda e: e["ptype"] == t), 1, REPORT_MAX_ENTITIES)))

    return F.when(F.size(entities) <= 1, entities).otherwise(let(F.array_distinct(entities), by_type))


def _summary(matches: Column, masked: Column, config: DetectorConfig) -> list[Column]:
    """What a report needs of a piece of a document: bounded, however long the piece is."""
    entities = F.transform(matches, lambda m: F.struct(m["ptype"].alias("ptype"), m["value"].alias("value")))
    tenths = F.aggregate(matches, F.lit(0).cast("long"), lambda acc, m: acc + F.round(weight_of(m["ptype"], config.weights, config.default_weight) * 10).cast("long"))
    shown = F.substring(masked, 1, REPORT_PREVIEW_CHARS + 1)
    return [F.size(matches).cast("long").alias("n"), tenths.alias("tenths"), _leading(entities).alias("found"), shown.alias("head"), F.length(masked).cast("long").alias("chars")]


SUMMARY = ["n", "tenths", "found", "head", "chars"]


def _join_summaries(pieces: DataFrame, into: Column) -> DataFrame:
    """Consecutive pieces as one, in a summary of the same bounded size."""
    grouped = pieces.groupBy("doc_id", into.alias("_into")).agg(F.array_sort(F.collect_list(F.struct("piece", *SUMMARY))).alias("r"))

    def total(name: str) -> Column:
        return F.aggregate("r", F.lit(0).cast("long"), lambda acc, x: acc + x[name]).alias(name)

    found = _leading(F.flatten(F.transform("r", lambda x: x["found"])))
    head = F.substring(F.array_join(F.transform("r", lambda x: x["head"]), ""), 1, REPORT_PREVIEW_CHARS + 1)
    return grouped.select("doc_id", F.col("_into").alias("piece"), total("n"), total("tenths"), found.alias("found"), head.alias("head"), total("chars"))


#: Positions of a document that meet in one task when spans are cut at its pieces.
CUT_CHARS = 1 << 16


def cut_at_pieces(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """Spans ``(doc_id, span_start, span_end, …)`` of whole documents, cut at the borders of pieces ``(doc_id, piece, offset, chars)``.

    An interval join: both sides are dealt by document and range of positions,
    and a pair that meets in several ranges counts in the first.  Adds
    ``piece``, ``_from`` and ``_to`` (within the piece, whose separator counts
    as its last character) and ``_first``, whether the span begins there.
    """

    def ranges(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / CUT_CHARS), F.floor((end - 1) / CUT_CHARS))

    stop = F.col("offset") + F.col("chars") + len(PAGE_SEPARATOR)
    right = pieces.select(F.col("doc_id").alias("_d"), "piece", F.col("offset").alias("_at"), stop.alias("_stop"), F.explode(ranges(F.col("offset"), stop)).alias("_s"))
    left = spans.withColumn("_r", F.explode(ranges(F.col("span_start"), F.col("span_end"))))
    first = F.floor(F.greatest("span_start", "_at") / CUT_CHARS)
    met = left.join(right, (F.col("doc_id") == F.col("_d")) & (F.col("_r") == F.col("_s")) & (F.col("span_start") < F.col("_stop")) & (F.col("span_end") > F.col("_at")) & (F.col("_r") == first))
    return met.select(
        *spans.columns,
        "piece",
        F.greatest(F.col("span_start") - F.col("_at"), F.lit(0)).cast("int").alias("_from"),
        (F.least("span_end", "_stop") - F.col("_at")).cast("int").alias("_to"),
        (F.col("span_start") >= F.col("_at")).alias("_first"),
    )


def _with_findings(thin: DataFrame, pieces: DataFrame, answers: DataFrame, config: DetectorConfig) -> DataFrame:
    """The summaries of all pieces, those that model findings reach made again with them.

    Findings are spans of the whole document.  Pieces that none of them
    overlaps stay as they are; the candidates of the others are moved to the
    document's positions and merged with the findings as rows, and the merged
    spans are cut at the pieces again.  A span shows its type where it begins.
    """
    fields = [f.name for f in MATCH_FIELDS]
    offsets = piece_offsets(thin, F.col("size") - len(PAGE_SEPARATOR)).checkpoint(eager=True)
    lengths = offsets.groupBy("doc_id").agg(F.max(F.col("offset") + F.col("chars")).alias("_length"))
    found = lengths.join(answers, F.col("doc_id") == F.col("_doc")).select("doc_id", findings_to_matches(F.col("_findings"), F.col("_length")).alias("m"))
    found = explode_matches(found, ["doc_id"], "m").select("doc_id", *fields).checkpoint(eager=True)
    reached = cut_at_pieces(found, offsets).select("doc_id", "piece").distinct()
    held = thin.join(reached, ["doc_id", "piece"], "left_semi").join(offsets.select("doc_id", "piece", "offset"), ["doc_id", "piece"])
    rows = explode_matches(held, ["doc_id", "offset"], "_cands")
    for c in ("span_start", "span_end"):
        rows = rows.withColumn(c, (F.col(c) + F.col("offset")).cast("int"))
    merged = merge_long(rows.select("doc_id", *fields).unionByName(found), ["doc_id"])
    cut = cut_at_pieces(merged, offsets)
    spans = F.array_sort(F.collect_list(F.struct(F.col("_from").alias("span_start"), F.col("_to").alias("span_end"), "_first", "ptype", "value")))
    cut = cut.groupBy("doc_id", "piece").agg(spans.alias("_spans"))
    none = F.array().cast("array<struct<span_start:int,span_end:int,_first:boolean,ptype:string,value:string>>")
    again = reached.join(cut, ["doc_id", "piece"], "left").select("doc_id", "piece", F.coalesce("_spans", none).alias("_spans"))
    texts = pieces.join(again, ["doc_id", "piece"])
    masked = mask_text(F.col("text"), F.col("_spans"), lambda m: F.when(m["_first"], type_token(m)).otherwise(F.lit("")))
    texts = texts.select("doc_id", "piece", F.filter("_spans", lambda m: m["_first"]).alias("_spans"), masked.alias("masked"))
    made = texts.select("doc_id", "piece", *_summary(F.col("_spans"), F.col("masked"), config))
    return thin.join(reached, ["doc_id", "piece"], "left_anti").select("doc_id", "piece", *SUMMARY).unionByName(made)


def page_report(
    pages: DataFrame,
    config: DetectorConfig = DEFAULT_CONFIG,
    doc_col: str = "doc_id",
    page_col: str = "page_no",
    text_col: str = "text",
    answers: DataFrame | None = None,
    allowlist_table: DataFrame | None = None,
) -> DataFrame:
    """J5 over whole documents given as pages, without assembling them.

    Pages are put together in pieces of some consecutive ones
    (:func:`piisift.sources.texts.document_pieces`).  No rule matches across a
    page header's brackets, so the findings of a document are those of its
    pieces.  Of each piece only a bounded summary goes on: match count, risk in
    whole tenths, leading entities, first characters and length of the masked
    text; summaries are joined in two rounds, so a document of very many pages
    stays spread out.  ``answers`` (raw model answers by ``doc_id``; see
    :func:`_with_findings`) and ``allowlist_table`` count as in the guard.
    A document without non-empty pages has no row; a null ``doc_id`` is a
    document without answers; other columns are not read.
    """
    pieces = document_pieces(pages, doc_col=doc_col, page_col=page_col, text_col=text_col)
    pieces = pieces.select("doc_id", "piece", F.concat("part", F.lit(PAGE_SEPARATOR)).alias("text"))
    found = with_candidates(pieces, "text", config)
    if allowlist_table is not None:
        found = with_listed_dropped(found, listed_keys(pieces, "text", config), allowlist_table)
    found = found.withColumn("matches", merge_matches(F.col("_cands")))
    found = found.withColumn("masked", mask_text(F.col("text"), F.col("matches")))
    summary = _summary(F.col("matches"), F.col("masked"), config)
    injected = F.lit(False)
    if answers is None:
        docs = found.select("doc_id", "piece", *summary)
    else:
        checkpoint_dir(pages.sparkSession)
        thin = found.select("doc_id", "piece", F.length("text").alias("size"), "_cands", *summary).checkpoint(eager=True)
        answered = model_answers(answers).checkpoint(eager=True)
        docs = _with_findings(thin, pieces, answered, config)
    docs = _join_summaries(_join_summaries(docs, F.floor(F.col("piece") / PIECE_PAGES)), F.lit(0))
    if answers is not None:
        verdicts = answered.select("_doc", F.col("_best.v.injection_detected").alias("_injected"))
        docs = docs.join(verdicts, F.col("doc_id") == F.col("_doc"), "left")
        injected = F.coalesce("_injected", F.lit(False))
    score = score_from_risk(F.col("tenths") / 10)
    size = F.col("chars") - len(PAGE_SEPARATOR)  # the last piece's separator is no part of the document
    text = F.when(size > REPORT_PREVIEW_CHARS, F.concat(F.substring("head", 1, REPORT_PREVIEW_CHARS), F.lit(REPORT_PREVIEW_ELLIPSIS))).otherwise(F.substring("head", F.lit(1), size.cast("int")))
    return docs.select(
        "doc_id",
        score.alias("pii_score"),
        ((score >= config.block_threshold) | injected).alias("blocked"),
        F.col("n").cast("int").alias("total_matches"),
        F.slice("found", 1, REPORT_MAX_ENTITIES).alias("entities"),
        F.when(injected, preview(F.lit(MSG_INJECTION))).when(score >= config.block_threshold, preview(F.lit(MSG_PII))).otherwise(text).alias("preview"),
    )


def allowlist_impact(
    df: DataFrame,
    before: DetectorConfig,
    after: DetectorConfig,
    text_col: str = "text",
) -> DataFrame:
    """Score with two allow-lists from one pass of the regex work.

    Candidates are found once (validated, not yet allow-listed); each allow-list
    filters a copy of the array, which is merged and scored.  Row form: no
    shuffle, no second scan.
    """
    c = with_candidates(df, text_col, before, allowlist=False)
    kept_before = c.select(
        "doc_id",
        drop_allowlisted("_cands", before.allowlist).alias("_kb"),
        drop_allowlisted("_cands", after.allowlist).alias("_ka"),
    )
    merged = kept_before.select(
        "doc_id",
        merge_matches(F.col("_kb")).alias("_before"),
        merge_matches(F.col("_ka")).alias("_after"),
        count_allowlisted("_kb", after.allowlist).alias("newly_filtered"),
    )
    return _impact_columns(merged, before, after)


def _impact_columns(merged: DataFrame, before: DetectorConfig, after: DetectorConfig) -> DataFrame:
    out = merged.select(
        "doc_id",
        F.size("_before").alias("matches_before"),
        F.size("_after").alias("matches_after"),
        score_from_risk(risk_value(F.col("_before"), before.weights, before.default_weight)).alias("score_before"),
        score_from_risk(risk_value(F.col("_after"), after.weights, after.default_weight)).alias("score_after"),
        "newly_filtered",
    )
    return out.withColumn("delta", F.col("score_after") - F.col("score_before"))


def qa_summary(results: DataFrame) -> DataFrame:
    """Per suite total, passed, failed and pass rate (percent, one decimal)."""
    passed = F.sum(F.when(F.col("status") == "PASS", 1).otherwise(0)).cast("long")
    total = F.count(F.lit(1))
    return results.groupBy("suite").agg(
        total.alias("total"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        F.round(F.lit(100.0) * passed / total, 1).alias("pass_rate"),
    )


def allowlist_impact_table(df: DataFrame, allow: DataFrame, before: DetectorConfig = DEFAULT_CONFIG, text_col: str = "text") -> DataFrame:
    """J7 with the second allow-list given as a ``(kind, value)`` table of any size.

    Candidates are found once and written without their texts to the shared
    checkpoint folder; the list's filters (:mod:`piisift.operators.allowlist`)
    are made exact for them and tested in the row expression, so rows stay
    where they are, whatever the size of the list.
    """
    checkpoint_dir(df.sparkSession)
    c = with_candidates(df.select("doc_id", text_col), text_col, before, allowlist=False).select("doc_id", "_cands").checkpoint(eager=True)
    keys = explode_matches(c, [], "_cands").where(F.col("ptype").isin(*sorted(LISTED_TYPES))).select("ptype", "value")
    kept = with_listed_dropped(c.withColumn("_ka", F.col("_cands")), keys, allow, "_ka")
    kept = kept.select("doc_id", drop_allowlisted("_cands", before.allowlist).alias("_kb"), "_ka")
    merged = kept.select(
        "doc_id",
        merge_matches(F.col("_kb")).alias("_before"),
        merge_matches(F.col("_ka")).alias("_after"),
        F.size(F.array_except("_kb", "_ka")).alias("newly_filtered"),
    )
    return _impact_columns(merged, before, before)
