"""Golden results (published and modelled) for the guard, scrub and score."""

from pyspark.sql import functions as F

from fixture_texts import CASES, SAMPLE, T1
from piisift.config import DEFAULT_ALLOWLIST, MSG_PII, DetectorConfig
from piisift.operators.guard import guard, scrub


def _guard_rows(spark, rows, config=DetectorConfig()):
    df = spark.createDataFrame(rows, "doc_id string, text string")
    return {r.doc_id: r for r in guard(df, config=config).collect()}


def test_fixture_goldens(spark):
    out = _guard_rows(spark, [(k, v[0]) for k, v in CASES.items()])
    for key, (text, score, blocked, masked, spans) in CASES.items():
        r = out[key]
        assert r.pii_score == score, key
        assert r.blocked == blocked, key
        if masked is not None:
            assert r.answer == masked, key
        assert [(m.ptype, m.span_start, m.span_end) for m in r.matches] == spans, key
        for m in r.matches:  # value is the span's text (CARD: stripped)
            raw = text[m.span_start : m.span_end]
            assert m.value == (raw.strip() if m.ptype == "CARD" else raw)


def test_published_t1_before_allowlist_change(spark):
    old = dict(DEFAULT_ALLOWLIST, phones=["1599-1111", "112", "1588-1234"])
    r = _guard_rows(spark, [("T1", T1)], DetectorConfig(allowlist=old))["T1"]
    assert r.pii_score == 49 and not r.blocked
    assert r.answer == "문의는 <PHONE> 또는 <EMAIL> 입니다. 카드<CARD>"
    assert [(m.ptype, m.value, m.span_start, m.span_end) for m in r.matches] == [
        ("PHONE", "010-9999-8888", 4, 17),
        ("EMAIL", "help@bank.com", 21, 34),
        ("CARD", "4111 1111 1111 1111", 42, 62),
    ]


def test_sample_document_is_blocked(spark):
    r = _guard_rows(spark, [("S", SAMPLE)])["S"]
    assert r.pii_score == 70 and r.blocked and r.answer == MSG_PII
    assert [(m.ptype, m.span_start, m.span_end) for m in r.matches] == [
        ("PHONE", 22, 35), ("EMAIL", 41, 56), ("ADDRESS", 61, 73), ("ACCOUNT", 115, 128), ("PHONE", 208, 221), ("EMAIL", 230, 245),
    ]
    # Blocking hides the text but not the raw values (parity), unless redaction is on.
    assert r.matches[0].value == "010-1234-5678"
    red = _guard_rows(spark, [("S", SAMPLE)], DetectorConfig(redact_values=True))["S"]
    assert all(m.value is None for m in red.matches)


def test_scrub_never_blocks_and_removes_every_match(spark):
    df = spark.createDataFrame([("S", SAMPLE)], "doc_id string, text string")
    r = scrub(df).collect()[0]
    assert r.scrubbed.count("<") == len(r.matches) == 6
    for m in r.matches:
        assert m.value not in r.scrubbed


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([("n", None), ("e", "")], "doc_id string, text string")
    out = {r.doc_id: r for r in guard(df).collect()}
    assert out["n"].answer is None and out["n"].pii_score == 0 and out["n"].blocked is False and out["n"].matches == []
    assert out["e"].answer == "" and out["e"].pii_score == 0


def test_score_boundaries(spark):
    from piisift.functions.matches import score_from_risk

    df = spark.createDataFrame([(0.0,), (3.5,), (3.6,), (100.0,)], "r double")
    got = [r.s for r in df.select(score_from_risk(F.col("r")).alias("s")).collect()]
    assert got == [0, 69, 70, 100]
