"""Model answers as a table: fences, parsing, defaults, hybrid merge, verdicts."""

from pyspark.sql import functions as F

from piisift.config import MSG_INJECTION
from piisift.functions.llm import llm_matches, parse_verdict, strip_fences
from piisift.operators.guard import hybrid_guard

TEXT = "고객 홍길동 010-1234-5678"


def test_strip_fences(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("```\n{}\n```",), ("  {} ",), ("x```json",)]
    got = [r.c for r in spark.createDataFrame(rows, "r string").select(strip_fences(F.col("r")).alias("c")).collect()]
    assert got == ['{"a": 1}', "{}", "  {} ", "x```json"]


def test_pii_items_normalised(spark):
    resp = (
        '```json\n{"pii_detected": ['
        '{"type": "name", "value": "홍길동", "start": 3, "end": 6, "confidence": 0.7},'
        '{"type": "phone", "value": "x", "confidence": 0.3},'
        '{"type": "", "value": "y", "start": 0, "end": 1},'
        '{"type": "id", "value": "고객", "start": 0},'
        '{"type": "card", "value": "zz", "start": 5, "end": 99}'
        "]}\n```"
    )
    rows = [("a", TEXT, resp), ("b", TEXT, "not json"), ("c", TEXT, '{"other": 1}')]
    df = spark.createDataFrame(rows, "doc_id string, text string, response string")
    got = {r.doc_id: r.m for r in df.select("doc_id", llm_matches(F.col("response"), F.col("text")).alias("m")).collect()}
    a = [(m.ptype, m.value, m.span_start, m.span_end, m.confidence, m.source) for m in got["a"]]
    # confidence 0.3 is not > 0.3; empty type dropped; end defaults to len(value); out-of-text span dropped.
    assert a == [("NAME", "홍길동", 3, 6, 0.7, "llm"), ("ID", "고객", 0, 2, 0.5, "llm")]
    assert got["b"] == [] and got["c"] == []


def test_verdicts(spark):
    rows = [
        ('{"injection_detected": true, "attack_types": ["JAILBREAK"], "confidence": 0.9, "details": "d"}',),
        ("```json\n{}\n```",),
        ("broken {",),
    ]
    got = [r.v for r in spark.createDataFrame(rows, "r string").select(parse_verdict(F.col("r")).alias("v")).collect()]
    assert (got[0].injection_detected, got[0].attack_types, got[0].confidence, got[0].details) == (True, ["JAILBREAK"], 0.9, "d")
    assert (got[1].injection_detected, got[1].attack_types, got[1].confidence, got[1].details) == (False, [], 0.0, "")
    assert got[2].details == "parsing_error" and got[2].injection_detected is False


def test_hybrid_guard(spark):
    texts = spark.createDataFrame([("a", TEXT), ("b", "안전한 문장"), ("c", TEXT)], "doc_id string, text string")
    responses = spark.createDataFrame(
        [
            ("a", "pii", '{"pii_detected": [{"type": "name", "value": "홍길동", "start": 3, "end": 6, "confidence": 0.9}]}'),
            ("b", "injection", '{"injection_detected": true, "attack_types": ["SYSTEM_OVERRIDE"], "confidence": 0.8, "details": "x"}'),
        ],
        "doc_id string, task string, response string",
    )
    out = {r.doc_id: r for r in hybrid_guard(texts, responses).collect()}
    a = out["a"]
    assert [(m.ptype, m.source) for m in a.matches] == [("NAME", "llm"), ("PHONE", "regex")]
    assert a.answer == "고객 <NAME> <PHONE>" and a.pii_score == 35  # R = 0.7 + 0.6 -> 35.2
    assert a.prompt_injection.details == "LLM not available"
    assert out["b"].blocked and out["b"].answer == MSG_INJECTION
    assert out["c"].answer == "고객 홍길동 <PHONE>"
