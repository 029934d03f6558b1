"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Outputs are flat (scalar columns, long form where a text has several matches)
so that the SQL oracle in :mod:`piisift.plans.oracle` can be compared value by
value.  Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisift.config import DEFAULT_ALLOWLIST, DOC_MAX_LENGTH, DetectorConfig
from piisift.functions.llm import default_verdict
from piisift.functions.matches import MATCH_FIELDS, risk_value, score_from_risk
from piisift.functions.validators import digits_only, luhn_valid
from piisift.operators.detect import DEFAULT_CONFIG, detect, explode_matches, with_candidates
from piisift.operators.expectations import checkable, evaluate
from piisift.operators.guard import attach_model_answers, guard, hybrid_guard, hybrid_matches, hybrid_scrub, scrub
from piisift.operators.longform import filter_allowlisted, merge_long
from piisift.operators.reports import allowlist_impact_table, page_report, qa_summary, top_entities
from piisift.operators.reports import document_report as build_document_report
from piisift.plans import inputs
from piisift.session import run_folder
from piisift.sources.scrubbed import read_scrubbed, update_scrubbed
from piisift.sources.texts import (
    allowlist_table,
    assemble_documents,
    document_pieces,
    guard_response,
    piece_offsets,
    read_llm_responses,
    read_requests,
    scrub_response,
)
from piisift.streaming.jobs import run_stream_guard, run_stream_guard_once, run_stream_hybrid_guard, run_stream_scrub

CANDIDATE_COLS = ["doc_id", "rule", "ptype", "value", "span_start", "span_end", "confidence"]
MATCH_COLS = ["doc_id", "pos", "ptype", "value", "span_start", "span_end", "confidence", "source"]


def _candidates_long(df: DataFrame, types: set[str], config: DetectorConfig = DEFAULT_CONFIG, **kw) -> DataFrame:
    c = with_candidates(df.select("doc_id", "text"), "text", config, types=types, **kw)
    return explode_matches(c, ["doc_id"], "_cands").select(
        "doc_id", F.col("ord").alias("rule"), "ptype", "value", "span_start", "span_end", "confidence"
    )


def _detect_type(ptype: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _candidates_long(inputs.all_texts(spark, sf_dir), {ptype})

    run.__name__ = f"detect_{ptype.lower()}"
    run.__doc__ = f"{ptype} candidates (validated, allow-listed, before the merge), one row per match."
    return run


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opt-in NAME rules (context, honorific, English first+last)."""
    cfg = DetectorConfig(name_candidates=True)
    return _candidates_long(inputs.all_texts(spark, sf_dir), {"NAME"}, cfg)


def luhn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CARD-shaped candidate with its digit count and Luhn verdict (V1)."""
    c = _candidates_long(inputs.all_texts(spark, sf_dir), {"CARD"}, validate=False, gates=False)
    return c.select(
        "doc_id",
        "span_start",
        "span_end",
        "value",
        F.length(digits_only(F.col("value"))).alias("n_digits"),
        luhn_valid(F.col("value")).alias("luhn_ok"),
    )


def _extended_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowlist_table(spark, DEFAULT_ALLOWLIST).unionByName(inputs.extended_allowlist(spark, sf_dir))


def whitelist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 as a size-checked broadcast anti-join against a table-derived allow-list."""
    c = _candidates_long(inputs.all_texts(spark, sf_dir), {"PHONE", "EMAIL", "ACCOUNT"}, allowlist=False)
    return filter_allowlisted(c, _extended_allow(spark, sf_dir)).select(*CANDIDATE_COLS)


def _large_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended_allow(spark, sf_dir).unionByName(inputs.large_allowlist(spark, sf_dir))


def scrub_large_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 with a list of several rows per order line (over 100,000 from sf0.01 on): every text scrubbed."""
    s = scrub(inputs.all_texts(spark, sf_dir), allowlist_table=_large_allow(spark, sf_dir))
    return s.select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


def whitelist_impact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 with the same list: the plan of ``whitelist_impact``, whatever the list's size."""
    return allowlist_impact_table(inputs.all_texts(spark, sf_dir), _large_allow(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(inputs.all_texts(spark, sf_dir))


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged (disjoint) matches of every text, one row per match."""
    return explode_matches(_merged(spark, sf_dir), ["doc_id"]).select(*MATCH_COLS)


#: Distance of the customers' sheets in one register; a sheet is longer, so neighbours' matches overlap.
SHEET_STEP = 120


def merge_spans_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3 on match rows: one text, the register of all customers' sheets, holds more of them than any other.

    The register is never put together: its rows are the sheets' candidates at
    the sheets' positions; all other texts bring their own.
    """
    fields = [f.name for f in MATCH_FIELDS]
    texts = inputs.all_texts(spark, sf_dir)
    rows = explode_matches(with_candidates(texts), ["doc_id"], "_cands").select("doc_id", *fields)
    sheet = F.col("doc_id").startswith("cust-")
    move = F.when(sheet, F.substring_index("doc_id", "-", -1).cast("int") * SHEET_STEP).otherwise(0)
    rows = rows.withColumns({c: F.col(c) + move for c in ("span_start", "span_end")})
    rows = rows.withColumn("doc_id", F.when(sheet, F.lit("register")).otherwise(F.col("doc_id")))
    merged = merge_long(rows, ["doc_id"])
    return merged.select("doc_id", "span_start", "span_end", F.col("ord").alias("rule"), "ptype", "value", "confidence")


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged matches per type and the number of texts holding that type.

    Row form marks each type's first match in a text, so one partially
    aggregated ``groupBy(ptype)`` (a hot type is combined map-side) gives both.
    """
    d = _merged(spark, sf_dir)
    types = F.transform("matches", lambda m: m["ptype"])
    flagged = F.transform(
        "matches", lambda m, i: F.struct(m["ptype"].alias("ptype"), (F.array_position(types, m["ptype"]) == i + 1).alias("first"))
    )
    long = d.select(F.explode_outer(flagged).alias("t")).where(F.col("t").isNotNull())
    return long.groupBy(F.col("t.ptype").alias("ptype")).agg(
        F.count(F.lit(1)).alias("n_matches"), F.sum(F.col("t.first").cast("long")).alias("n_docs")
    )


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text: merged match count, weighted risk R and the 0-100 score."""
    d = detect(inputs.all_texts(spark, sf_dir), internal=True)
    r = d.select("doc_id", F.size("matches").alias("n_matches"), risk_value(F.col("matches")).alias("_risk"))
    return r.select("doc_id", "n_matches", F.round("_risk", 4).alias("risk"), score_from_risk(F.col("_risk")).alias("pii_score"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its merged spans replaced by ``<TYPE>``."""
    s = scrub(inputs.all_texts(spark, sf_dir))
    return s.select("doc_id", F.col("scrubbed").alias("masked"))


def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 over the document corpus."""
    s = scrub(inputs.corpus(spark, sf_dir).select("doc_id", "text"))
    return s.select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


def scrub_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with an allow-list given as a table (S5): every text scrubbed with the
    shipped list plus the table-derived entries."""
    s = scrub(inputs.all_texts(spark, sf_dir), allowlist_table=_extended_allow(spark, sf_dir))
    return s.select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


GUARD_COLS = ["doc_id", "answer", "pii_score", "blocked"]


def _guard_row(g: DataFrame) -> DataFrame:
    return g.select(
        *GUARD_COLS,
        F.size("matches").alias("n_matches"),
        F.col("prompt_injection.injection_detected").alias("injection_detected"),
        F.col("prompt_injection.details").alias("details"),
    )


def guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 over every text."""
    return _guard_row(guard(inputs.all_texts(spark, sf_dir)))


def guard_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the JSON response of the guard for every text."""
    return guard_response(guard(inputs.all_texts(spark, sf_dir)))


def scrub_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the JSON response of scrub for every text."""
    return scrub_response(scrub(inputs.all_texts(spark, sf_dir)))


# -- model answers (stand-in raw responses composed from the tables) ---------


def pii_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw PII answers ``(doc_id, task, answer_no, response)``: plain, fenced, with defaults, not
    JSON, single-quoted, with trailing prose, and with fields of other JSON types; every fifth
    document has a second answer."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    start = (F.instr(F.col("text"), word) - 1).cast("string")
    end = (F.instr(F.col("text"), word) - 1 + F.length(word)).cast("string")

    def item(kind: str, first: F.Column, last: F.Column, more: str) -> F.Column:
        head = F.concat(F.lit(f'{{"type": "{kind}", "value": "'), word, F.lit('", "start": '), first)
        return F.concat(head, F.lit(', "end": '), last, F.lit(more + "}"))

    def answer(*items: F.Column) -> F.Column:
        return F.concat(F.lit('{"pii_detected": ['), F.concat_ws(", ", *items), F.lit("]}"))

    good = item("name", start, end, ', "confidence": 0.8')
    weak = F.lit('{"type": "email", "value": "x", "confidence": 0.2}')
    full = answer(good, weak)
    partial = F.concat(F.lit('{"pii_detected": [{"type": "id_number", "value": "'), word, F.lit('", "start": '), start, F.lit("}]}"))
    quoted = F.concat(F.lit('"'), start, F.lit('"'))
    shapes = [
        full,
        F.concat(F.lit("```json\n"), full, F.lit("\n```")),
        F.concat(F.lit("```\n"), partial, F.lit("\n```")),
        F.lit("Sorry, no JSON here"),
        F.replace(full, F.lit('"'), F.lit("'")),
        F.concat(full, F.lit(" Hope this helps.")),
        answer(item("name", F.concat(start, F.lit(".0")), F.concat(end, F.lit(".0")), ', "confidence": 0.8')),
        answer(item("name", quoted, end, ""), item("phone", start, end, "")),
        answer(item("name", start, end, ', "confidence": null'), item("address", start, end, ', "confidence": 0.7')),
        answer(F.lit('"oops"'), good),
        answer(item("account", start, end, ', "confidence": "high"'), good),
        answer(item("card", start, end, ', "confidence": 1')),
    ]
    response = F.element_at(F.array(*shapes), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    doc_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id")
    firsts = d.select(doc_id, F.lit("pii").alias("task"), F.lit(1).alias("answer_no"), response.alias("response"))
    seconds = d.where(F.col("doc_id") % 5 == 0).select(doc_id, F.lit("pii").alias("task"), F.lit(2).alias("answer_no"), partial.alias("response"))
    return firsts.unionByName(seconds)


def injection_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw injection answers for every user turn: plain JSON, fenced, not JSON, single-quoted, with
    trailing prose and with other JSON types; every fourth conversation has a second answer.
    Assistant turns have none (-> "no model" default)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("role") == "user")
    flagged = (F.length("text") % 3 == 0).cast("string")
    plain = F.concat(F.lit('{"injection_detected": '), flagged, F.lit(', "attack_types": ["JAILBREAK", "ROLE_MANIPULATION"], "confidence": 0.9, "details": "pattern"}'))
    shapes = [
        plain,
        F.lit('```json\n{"injection_detected": false, "attack_types": [], "confidence": 0.1, "details": "clean"}\n```'),
        F.lit("model error {"),
        F.replace(plain, F.lit('"'), F.lit("'")),
        F.concat(plain, F.lit(" That is all.")),
        F.lit('{"injection_detected": "true", "confidence": "0.9", "details": 7}'),
        F.lit('{"injection_detected": 1, "confidence": 1}'),
        F.lit('{"injection_detected": null, "confidence": null}'),
    ]
    response = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % len(shapes) + 1).cast("int"))
    doc_id = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("doc_id")
    firsts = c.select(doc_id, F.lit("injection").alias("task"), F.lit(1).alias("answer_no"), response.alias("response"))
    seconds = c.where(F.col("conv_id") % 4 == 0).select(doc_id, F.lit("injection").alias("task"), F.lit(2).alias("answer_no"), F.lit("~clean").alias("response"))
    return firsts.unionByName(seconds)


def llm_pii_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3 + V5: model findings parsed and normalised, one row per finding.

    Answers are pre-aggregated to one row per document before the join, so a
    document with very many answers cannot skew it.
    """
    texts = inputs._corpus(spark, sf_dir).select("doc_id", "text")
    found = attach_model_answers(texts, pii_responses(spark, sf_dir)).select("doc_id", "llm_matches")
    return explode_matches(found, ["doc_id"], "llm_matches").select(
        "doc_id", F.col("pos").alias("idx"), "ptype", "value", "span_start", "span_end", "confidence"
    )


def llm_answers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings from answers that were written as JSON and read as a table."""
    path = f"{run_folder(spark, 'answers')}/answers"
    pii_responses(spark, sf_dir).write.json(path)
    found = attach_model_answers(inputs._corpus(spark, sf_dir).select("doc_id", "text"), read_llm_responses(spark, path, "json"))
    return explode_matches(found.select("doc_id", "llm_matches"), ["doc_id"], "llm_matches").select(
        "doc_id", F.col("pos").alias("idx"), "ptype", "value", "span_start", "span_end", "confidence"
    )


def llm_hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex and model findings merged together (regex first in emission order)."""
    d = hybrid_matches(inputs.corpus(spark, sf_dir).select("doc_id", "text"), pii_responses(spark, sf_dir))
    return explode_matches(d, ["doc_id"]).select(*MATCH_COLS)


def hybrid_guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 row by row: documents with their PII answers and user turns with their injection answers."""
    texts = inputs._corpus(spark, sf_dir).select("doc_id", "text").unionByName(inputs._conversation_turns(spark, sf_dir))
    return _guard_row(hybrid_guard(texts, pii_responses(spark, sf_dir).unionByName(injection_responses(spark, sf_dir))))


def hybrid_scrub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 with model findings over the document corpus."""
    s = hybrid_scrub(inputs._corpus(spark, sf_dir).select("doc_id", "text"), pii_responses(spark, sf_dir))
    return s.select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


def injection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 + L5: verdict per conversation turn (parsed, parse error, or no-model default)."""
    texts = inputs._conversation_turns(spark, sf_dir)
    j = attach_model_answers(texts, injection_responses(spark, sf_dir))
    out = j.select("doc_id", F.coalesce(F.col("verdict"), default_verdict()).alias("v"))
    return out.select(
        "doc_id",
        F.col("v.injection_detected").alias("injection_detected"),
        F.array_join("v.attack_types", ",").alias("attack_types"),
        F.col("v.confidence").alias("confidence"),
        F.col("v.details").alias("details"),
    )


def guard_block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 over every conversation turn and customer sheet: texts per block reason."""
    both = inputs._conversation_turns(spark, sf_dir).unionByName(inputs._customer_records(spark, sf_dir))
    g = hybrid_guard(both, injection_responses(spark, sf_dir))
    reason = (
        F.when(F.col("prompt_injection.injection_detected"), F.lit("injection"))
        .when(F.col("blocked"), F.lit("pii"))
        .otherwise(F.lit("none"))
    )
    return g.groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.size("matches")).cast("long").alias("n_matches"),
        F.max("pii_score").alias("max_score"),
    )


# -- documents from pages ---------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in page table: each line of a document is one page (the assembly
    shuffles by document anyway, so the scan is not spread first)."""
    d = inputs._corpus(spark, sf_dir)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("page_no"), "text"
    )


def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: pages -> headed, joined, whole document text."""
    docs = assemble_documents(_pages(spark, sf_dir))
    return docs.select("doc_id", "text", F.length("text").alias("n_chars"))


def document_pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 without assembly: a document's text as parts and where they begin."""
    pieces = document_pieces(_pages(spark, sf_dir), piece_pages=4)
    at = piece_offsets(pieces, F.length("part"), group=4)
    return pieces.join(at, ["doc_id", "piece"]).select("doc_id", "piece", "offset", "part")


def document_assembly_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4: the same under the opt-in cap of 10,000 characters."""
    docs = assemble_documents(_pages(spark, sf_dir), max_length=DOC_MAX_LENGTH)
    return docs.select("doc_id", "text", F.length("text").alias("n_chars"))


def _report_columns(r: DataFrame) -> DataFrame:
    return r.select(
        "doc_id",
        "pii_score",
        "blocked",
        "total_matches",
        F.size("entities").alias("n_entities"),
        F.array_join(F.transform("entities", lambda e: F.concat(e["ptype"], F.lit("="), e["value"])), "; ").alias("entities"),
        "preview",
    )


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per whole document score, blocked, match count, top-20 entities, preview (detected page by page)."""
    return _report_columns(page_report(_pages(spark, sf_dir)))


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII answers of every document that is no multiple of 4, and an injection answer for every third document."""
    pii = pii_responses(spark, sf_dir).where(F.substring_index("doc_id", "-", -1).cast("long") % 4 != 0)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") % 3 == 0)
    verdict = F.when(F.col("doc_id") % 2 == 0, F.lit('{"injection_detected": true, "details": "pattern"}')).otherwise(F.lit('{"injection_detected": false}'))
    doc_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id")
    return pii.unionByName(d.select(doc_id, F.lit("injection").alias("task"), F.lit(1).alias("answer_no"), verdict.alias("response")))


def document_report_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 with model answers: their findings are merged, and an injection verdict blocks the document."""
    return _report_columns(page_report(_pages(spark, sf_dir), answers=document_answers(spark, sf_dir)))


def document_report_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 over documents under the opt-in cap of 10,000 characters."""
    return _report_columns(build_document_report(assemble_documents(_pages(spark, sf_dir), max_length=DOC_MAX_LENGTH)))


def top_entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entities per text in first-seen order, at most 20."""
    d = detect(inputs.all_texts(spark, sf_dir))
    e = d.select("doc_id", F.posexplode_outer(top_entities(F.col("matches"))).alias("rank", "e"))
    return e.where(F.col("rank").isNotNull()).select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("e.ptype").alias("ptype"), F.col("e.value").alias("value"))


def whitelist_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score before/after extending the allow-list, per text."""
    return allowlist_impact_table(inputs.all_texts(spark, sf_dir), _extended_allow(spark, sf_dir))


#: The QA runner's expectations: (source of texts, suite, kind, argument).
QA_CHECKS = [
    ("contacts", "guard_contacts", "score_above", "0"),
    ("contacts", "guard_contacts", "type_present", "EMAIL"),
    ("contacts", "guard_contacts", "type_present", "ACCOUNT"),
    ("contacts", "guard_contacts", "blocked_or_masked_contains", "<EMAIL>"),
    ("contacts", "scrub_accounts", "type_present", "ACCOUNT"),
    ("contacts", "scrub_accounts", "masked_contains", "<ACCOUNT>"),
    ("answers", "guard_safe", "score_is", "0"),
    ("answers", "guard_safe", "matches_are", "0"),
    ("orders", "guard_rrn", "type_absent", "RRN"),
    ("orders", "guard_rrn_low_score", "score_at_most", "10"),
    ("suppliers", "whitelist_after", "delta_at_most", "0"),
]


def _checkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' sheets, assistant turns, order notes and the allow-list's effect on suppliers' contacts, ready for checks."""
    parts = [
        checkable(inputs.dealt(spark, inputs.customer_records(spark, sf_dir)), "contacts"),
        checkable(inputs.conversation_turns(spark, sf_dir, role="assistant"), "answers"),
        checkable(inputs.dealt(spark, inputs.order_notes(spark, sf_dir)), "orders"),
    ]
    impact = allowlist_impact_table(inputs.dealt(spark, inputs.supplier_contacts(spark, sf_dir)), _extended_allow(spark, sf_dir))
    types = {f.name: f.dataType for f in parts[0].schema.fields}
    given = {"doc_id": F.col("doc_id"), "source": F.lit("suppliers"), "score": F.col("score_after"), "delta": F.col("delta")}
    out = impact.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    for p in parts:
        out = out.unionByName(p)
    return out


def qa_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expectation table evaluated over every text of its sources, one row per suite and text."""
    checks = spark.createDataFrame(QA_CHECKS, "source string, suite string, kind string, argument string")
    return evaluate(_checkable(spark, sf_dir), checks, by="source")


def qa_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 with expectations of single documents: what each customer's sheet and order note must show."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    doc_id = F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("doc_id")
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    checks = c.select(doc_id, F.lit("mail_found").alias("suite"), F.lit("value_present").alias("kind"), mail.alias("argument"))
    checks = checks.unionByName(c.select(doc_id, F.lit("mail_found").alias("suite"), F.lit("masked_lacks").alias("kind"), mail.alias("argument")))
    high = F.when(F.col("c_nationkey") < 10, "true").otherwise("false")
    checks = checks.unionByName(c.select(doc_id, F.lit("blocked_as_told").alias("suite"), F.lit("blocked_is").alias("kind"), high.alias("argument")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("doc_id")
    kind = F.when(F.col("o_custkey") % 2 == 0, "type_absent").otherwise("type_present")
    checks = checks.unionByName(o.select(note, F.lit("rrn_as_told").alias("suite"), kind.alias("kind"), F.lit("RRN").alias("argument")))
    return evaluate(_checkable(spark, sf_dir), checks, by="doc_id")


def qa_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass counts and pass rate per suite."""
    return qa_summary(qa_results(spark, sf_dir))


def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus risk per (lang, source): texts, texts with PII, blocked, matches, scores."""
    g = guard(inputs.corpus(spark, sf_dir))
    return g.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.size("matches") > 0, 1).otherwise(0)).cast("long").alias("n_with_pii"),
        F.sum(F.when(F.col("blocked"), 1).otherwise(0)).cast("long").alias("n_blocked"),
        F.sum(F.size("matches")).cast("long").alias("n_matches"),
        F.max("pii_score").alias("max_score"),
        F.round(F.avg("pii_score"), 4).alias("avg_score"),
    )


def scrub_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a scrubbed corpus brought up to date: rows were changed, added and removed since it was made."""
    path = f"{run_folder(spark, 'corpus')}/scrubbed"
    docs = inputs.corpus(spark, sf_dir).select("doc_id", "text")
    number = F.substring_index("doc_id", "-", -1).cast("long")
    before = docs.where(number % 11 != 3).withColumn("text", F.when(number % 17 == 0, F.concat(F.lit("010-1234-5678 "), F.col("text"))).otherwise(F.col("text")))
    before = before.unionByName(docs.where(number % 13 == 0).withColumn("doc_id", F.concat(F.lit("old-"), number.cast("string"))))
    update_scrubbed(before, path, buckets=16)
    update_scrubbed(docs, path, buckets=16)
    return read_scrubbed(spark, path).select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies made of the documents, one JSON line each; six of ten are as they should be."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    good = F.to_json(F.struct(key.alias("doc_id"), "text"))
    shapes = [
        F.concat(F.lit('{"doc_id": "'), key, F.lit('", "text": ')),
        F.concat(F.lit('{"doc_id": "'), key, F.lit('", "body": "x"}')),
        F.concat(F.lit('{"doc_id": "'), key, F.lit('", "text": null}')),
        F.concat(F.lit('{"doc_id": "'), key, F.lit('", "text": '), F.col("doc_id").cast("string"), F.lit("}")),
        F.concat(F.lit('["'), key, F.lit('"]')),
    ]
    line = F.get(F.array(*shapes), (F.col("doc_id") % 10).cast("int"))
    return d.select(F.when((F.col("doc_id") % 10 >= len(shapes)) & F.col("text").isNotNull(), good).otherwise(F.coalesce(line, shapes[2])).alias("value"))


def requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies read from JSON lines, with the reason where one is not taken."""
    path = f"{run_folder(spark, 'requests')}/lines"
    request_bodies(spark, sf_dir).write.text(path)
    return read_requests(spark, path)


def stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard as a Structured Streaming query over the document files."""
    return run_stream_guard(spark, sf_dir)


def stream_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrub as a Structured Streaming query over the document files."""
    return run_stream_scrub(spark, sf_dir)


def stream_guard_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 over requests that are sent again, in two runs of the stream: each document once."""
    return run_stream_guard_once(spark, inputs.corpus(spark, sf_dir))


def stream_hybrid_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + J10: texts and model answers as two streams; the answers come later, some texts get none."""
    return run_stream_hybrid_guard(spark, inputs.corpus(spark, sf_dir), document_answers(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_phone": _detect_type("PHONE"),
    "detect_email": _detect_type("EMAIL"),
    "detect_card": _detect_type("CARD"),
    "detect_rrn": _detect_type("RRN"),
    "detect_account": _detect_type("ACCOUNT"),
    "detect_address": _detect_type("ADDRESS"),
    "detect_id_number": _detect_type("ID_NUMBER"),
    "name_candidates": name_candidates,
    "luhn_filter": luhn_filter,
    "whitelist_filter": whitelist_filter,
    "merge_spans": merge_spans,
    "merge_spans_long": merge_spans_long,
    "type_counts": type_counts,
    "risk_score": risk_score,
    "mask_documents": mask_documents,
    "scrub_documents": scrub_documents,
    "scrub_allowlisted": scrub_allowlisted,
    "scrub_large_allowlist": scrub_large_allowlist,
    "scrub_incremental": scrub_incremental,
    "requests_read": requests_read,
    "guard_documents": guard_documents,
    "guard_block_reasons": guard_block_reasons,
    "llm_pii_parse": llm_pii_parse,
    "llm_answers_table": llm_answers_table,
    "llm_hybrid_merge": llm_hybrid_merge,
    "injection_verdicts": injection_verdicts,
    "hybrid_guard": hybrid_guard_rows,
    "hybrid_scrub": hybrid_scrub_rows,
    "guard_response": guard_responses,
    "scrub_response": scrub_responses,
    "guard_response_all": guard_responses,
    "scrub_response_all": scrub_responses,
    "document_assembly": document_assembly,
    "document_assembly_capped": document_assembly_capped,
    "document_pieces": document_pieces_query,
    "document_report": document_report,
    "document_report_answers": document_report_answers,
    "document_report_capped": document_report_capped,
    "qa_results": qa_results,
    "qa_expectations": qa_expectations,
    "top_entities": top_entities_query,
    "whitelist_impact": whitelist_impact,
    "whitelist_impact_large": whitelist_impact_large,
    "qa_summary": qa_summary_query,
    "risk_by_source": risk_by_source,
    "stream_guard": stream_guard,
    "stream_scrub": stream_scrub,
    "stream_guard_once": stream_guard_once,
    "stream_hybrid_guard": stream_hybrid_guard,
}
