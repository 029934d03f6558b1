"""Model answers of every shape, several answers per text, and page-wise reports."""

import random

from pyspark.sql import functions as F

from piisift.functions.llm import llm_findings, parse_verdict
from piisift.operators.guard import hybrid_guard, hybrid_scrub
from piisift.operators.reports import document_report, page_report
from piisift.sources.texts import assemble_documents

GOOD = '{"type": "name", "value": "abc", "start": 0, "end": 3, "confidence": 0.8}'


def findings(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    return {r["i"]: [(m["ptype"], m["s"], m["e"], m["confidence"]) for m in r["f"]] for r in df.select("i", llm_findings(F.col("a")).alias("f")).collect()}


def test_only_one_json_object_counts(spark):
    body = '{"pii_detected": [' + GOOD + "]}"
    got = findings(spark, [body, body.replace('"', "'"), body + " thanks", "```json\n" + body + "\n```", body + body, "[" + body + "]", "", None])
    assert [len(got[i]) for i in range(8)] == [1, 0, 0, 1, 0, 0, 0, 0]


def test_fields_of_other_types_drop_their_item(spark):
    items = [
        '{"type": "name", "value": "abc", "start": 4.0, "end": 6.0}',
        '{"type": "name", "value": "abc", "start": "0"}',
        '{"type": "name", "value": "abc", "confidence": null}',
        '{"type": "name", "value": "abc", "confidence": "0.9"}',
        '{"type": 1, "value": "abc"}',
        '{"type": "name", "value": "abc"}',
        '{"type": "name", "value": "abc", "confidence": 1}',
    ]
    got = findings(spark, ['{"pii_detected": [' + x + ", " + GOOD + "]}" for x in items] + ['{"pii_detected": ["oops", ' + GOOD + "]}"])
    assert [len(got[i]) for i in range(8)] == [1, 1, 1, 1, 1, 2, 2, 0]
    assert got[5][0] == ("NAME", 0, 3, 0.5)


def test_injection_counts_as_truth_value(spark):
    flags = ["true", "false", '"true"', '""', "1", "0", "null", "[1]", "[]", "{}"]
    rows = [(i, '{"injection_detected": %s}' % f) for i, f in enumerate(flags)] + [(10, "{}"), (11, "{'injection_detected': true}")]
    got = spark.createDataFrame(rows, "i int, a string").select("i", parse_verdict(F.col("a")).alias("v")).collect()
    assert [r["v"]["injection_detected"] for r in sorted(got)] == [True, False, True, False, True, False, False, True, False, False, False, False]
    assert sorted(got)[11]["v"]["details"] == "parsing_error"


def test_every_answer_of_a_text_is_kept(spark):
    texts = spark.createDataFrame([("d", "abc def ghi"), ("e", "abc")], "doc_id string, text string")
    rows = [
        ("d", "injection", 1, '{"injection_detected": true}'),
        ("d", "injection", 2, "~clean"),
        ("d", "pii", 2, '{"pii_detected": [{"type": "mail", "value": "def", "start": 4, "end": 7}]}'),
        ("d", "pii", 1, '{"pii_detected": [' + GOOD + "]}"),
        ("e", "injection", 1, "~clean"),
    ]
    answers = spark.createDataFrame(rows, "doc_id string, task string, answer_no int, response string")
    got = {r["doc_id"]: r for r in hybrid_guard(texts, answers).collect()}
    assert got["d"]["blocked"] and [m["ptype"] for m in got["d"]["matches"]] == ["NAME", "MAIL"]
    assert not got["e"]["blocked"] and got["e"]["prompt_injection"]["details"] == "parsing_error"
    scrubbed = {r["doc_id"]: r["scrubbed"] for r in hybrid_scrub(texts, answers.drop("answer_no")).collect()}
    assert scrubbed == {"d": "<NAME> <MAIL> ghi", "e": "abc"}


def test_report_by_pages_equals_report_of_whole_documents(spark):
    rnd = random.Random(9)
    bits = ["010-1234-5678", "a@b.co", "서울시 강남구 역삼동 12번지", "12345", "4111 1111 1111 1111", "plain words", "계좌번호: 123-45-678901", "900101-1234567", "-", "\n", "KR123456"]
    rows = []
    for d in range(25):
        for p in range(1, rnd.choice([1, 2, 5, 60])):
            rows.append((f"d{d}", p * rnd.choice([1, 1, 1000]) + p, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12)))))
    rows.append(("null", 1, None))
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string").dropDuplicates(["doc_id", "page_no"])
    by_page = {r["doc_id"]: r for r in page_report(pages).collect()}
    whole = {r["doc_id"]: r for r in document_report(assemble_documents(pages)).collect()}
    assert by_page.keys() == whole.keys() and len(whole) > 5
    for d, r in whole.items():
        assert by_page[d].asDict(True) == r.asDict(True)


def test_page_report_takes_answers(spark):
    pages = spark.createDataFrame([("a", 1, "abc def"), ("a", 2, "ghi"), ("b", 1, "plain"), ("c", 1, "call 010-1234-5678"), ("d", 1, "x y")], "doc_id string, page_no int, text string")
    text = {r["doc_id"]: r["text"] for r in assemble_documents(pages).collect()}
    at, end = text["a"].index("def"), text["a"].index("ghi") + 3
    rows = [
        ("a", "pii", f'{{"pii_detected": [{{"type": "name", "value": "def ghi", "start": {at}, "end": {end}, "confidence": 0.9}}]}}'),
        ("b", "injection", '{"injection_detected": true, "details": "x"}'),
        ("d", "pii", None),
    ]
    answers = spark.createDataFrame(rows, "doc_id string, task string, response string")
    got = {r["doc_id"]: r for r in page_report(pages, answers=answers).collect()}
    plain = {r["doc_id"]: r for r in page_report(pages).collect()}
    assert got.keys() == plain.keys() and (got["c"], got["d"]) == (plain["c"], plain["d"])
    assert got["a"]["total_matches"] == 1 and got["a"]["entities"][0]["ptype"] == "NAME" and "<NAME>" in got["a"]["preview"] and "ghi" not in got["a"]["preview"]
    assert got["b"]["blocked"] and not plain["b"]["blocked"] and "plain" not in got["b"]["preview"]


def test_report_with_answers_by_pages_equals_whole_documents(spark):
    """Findings inside pages, over page and piece borders, over all of a document, chained, and out of range."""
    import json

    rnd = random.Random(21)
    bits = ["010-1234-5678", "a@b.co", "서울시 강남구 역삼동 12번지", "12345", "4111 1111 1111 1111", "plain words", "KR123456", "x" * 50]
    rows = [(f"d{d}", p, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 8)))) for d in range(30) for p in range(1, rnd.choice([2, 6, 150]))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    whole = assemble_documents(pages)
    answers = []
    for r in whole.collect():
        n = len(r["text"])
        if rnd.random() < 0.25:
            continue
        found = []
        for _ in range(rnd.choice([0, 1, 3, 12])):
            start = rnd.randrange(n)
            end = rnd.choice([start + rnd.randrange(1, 40), start + rnd.randrange(1, 3000), n, n + 1])
            found.append({"type": rnd.choice(["name", "card", "note"]), "value": f"v{rnd.randrange(9)}", "start": start, "end": end, "confidence": rnd.choice([0.4, 0.7, 0.85, 0.97])})
        answers.append((r["doc_id"], "pii", 1, json.dumps({"pii_detected": found})))
        if rnd.random() < 0.3:
            answers.append((r["doc_id"], "pii", 2, json.dumps({"pii_detected": [{"type": "all", "value": "v", "start": 0, "end": n, "confidence": 0.6}]})))
        if rnd.random() < 0.2:
            answers.append((r["doc_id"], "injection", 1, '{"injection_detected": true}'))
    given = spark.createDataFrame(answers, "doc_id string, task string, answer_no int, response string")
    by_page = {r["doc_id"]: r.asDict(True) for r in page_report(pages, answers=given).collect()}
    want = {r["doc_id"]: r.asDict(True) for r in document_report(whole, answers=given).collect()}
    assert by_page.keys() == want.keys() and len(want) > 20
    for d in want:
        assert by_page[d] == want[d]
    none = {r["doc_id"]: r.asDict(True) for r in page_report(pages, answers=given.limit(0)).collect()}
    assert none == {r["doc_id"]: r.asDict(True) for r in page_report(pages).collect()}


def test_report_takes_an_allowlist_table(spark):
    pages = spark.createDataFrame([("a", 1, "010-1234-5678 and a@b.co"), ("a", 2, "c@d.ef")], "doc_id string, page_no int, text string")
    allow = spark.createDataFrame([("phones", "010-1234-5678"), ("emails", "c@d.ef")], "kind string, value string")
    r = page_report(pages, allowlist_table=allow).first()
    assert r["total_matches"] == 1 and [e["value"] for e in r["entities"]] == ["a@b.co"]
