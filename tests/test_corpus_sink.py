"""The scrubbed corpus that is brought up to date, the expectation table, request bodies."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from piisift.config import DetectorConfig
from piisift.operators.expectations import checkable, evaluate
from piisift.operators.guard import scrub
from piisift.plans import catalog, inputs
from piisift.session import run_folder
from piisift.sources.scrubbed import read_scrubbed, update_scrubbed
from piisift.sources.texts import read_requests


def rows(df):
    return sorted(((r.doc_id, r.scrubbed, len(r.matches or [])) for r in df.collect()), key=str)


def times(path):
    path = path.removeprefix("file:")
    return {d: sorted(os.path.getmtime(f"{path}/{d}/{f}") for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_updates_write_changed_buckets_only(spark):
    path = f"{run_folder(spark, 'sink')}/corpus"
    texts = [(f"d{i}", f"call 010-1234-{i:04d}") for i in range(60)] + [("dup", "a@b.co"), ("dup", "a@b.co"), ("dup", "x"), (None, "b@c.de"), ("null", None), ("empty", "")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    assert update_scrubbed(docs, path, buckets=8) == list(range(8))
    assert rows(read_scrubbed(spark, path)) == rows(scrub(docs))
    before = times(path)
    assert update_scrubbed(docs.repartition(3), path, buckets=8) == [] and times(path) == before

    changed = [t for t in texts if t[0] not in ("d7", "null")] + [("d8", "new text 02-123-4567"), ("dup", "a@b.co")]
    changed.remove(("d9", "call 010-1234-0009"))
    docs = spark.createDataFrame(changed, "doc_id string, text string")
    written = update_scrubbed(docs, path, buckets=8)
    assert rows(read_scrubbed(spark, path)) == rows(scrub(docs))
    after = times(path)
    assert 0 < len(written) < 8 and {d for d in before if before[d] != after[d]} == {f"bucket={b}" for b in written}

    assert update_scrubbed(docs, path, config=DetectorConfig(allowlist={"emails": ["a@b.co"]}), buckets=8) != []  # other rules: all rows again
    assert rows(read_scrubbed(spark, path)) == rows(scrub(docs, config=DetectorConfig(allowlist={"emails": ["a@b.co"]})))
    update_scrubbed(docs.limit(0), path, buckets=8)
    assert read_scrubbed(spark, path).count() == 0
    update_scrubbed(docs, path, buckets=8)
    assert rows(read_scrubbed(spark, path)) == rows(scrub(docs))


def test_update_of_nothing(spark):
    path = f"{run_folder(spark, 'sink')}/corpus"
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    update_scrubbed(docs, path, buckets=2)
    update_scrubbed(docs.limit(0), path, buckets=2)
    assert update_scrubbed(docs.limit(0), path, buckets=2) == [] and read_scrubbed(spark, path).count() == 0


def test_kinds_of_checks(spark):
    wanted = [
        ("type_present", "PHONE", "PASS"), ("type_present", "CARD", "FAIL"), ("type_absent", "CARD", "PASS"), ("value_present", "a@b.co", "PASS"), ("value_absent", "a@b.co", "FAIL"),
        ("masked_contains", "<EMAIL>", "PASS"), ("masked_lacks", "010", "PASS"), ("blocked_or_masked_contains", "<PHONE>", "PASS"), ("blocked_is", "false", "PASS"), ("blocked_is", "true", "FAIL"),
        ("matches_are", "2", "PASS"), ("matches_are", "two", "FAIL"), ("score_is", "31", "PASS"), ("score_above", "31", "FAIL"), ("score_at_most", "31", "PASS"), ("delta_at_most", "0", "FAIL"),
        ("no_such_check", "x", "FAIL"), ("type_present", None, "FAIL"), (None, "PHONE", "FAIL"),
    ]
    texts = spark.createDataFrame([("d", "call 010-1234-5678 or a@b.co")], "doc_id string, text string")
    rows = [("d", f"s{i}", kind, argument) for i, (kind, argument, _) in enumerate(wanted)] + [("other", "s", "type_present", "CARD")]
    checks = spark.createDataFrame(rows, "doc_id string, suite string, kind string, argument string")
    got = {r.suite: r.status for r in evaluate(checkable(texts, "t"), checks).collect()}
    assert got == {f"s{i}": want for i, (_, _, want) in enumerate(wanted)}


def test_a_suite_passes_when_all_its_checks_hold(spark):
    texts = spark.createDataFrame([("a", "010-1234-5678"), ("b", "none"), (None, "x")], "doc_id string, text string")
    rows = [("t", "one", "type_present", "PHONE"), ("t", "one", "masked_lacks", "none"), ("t", "two", "masked_lacks", "zzz"), ("u", "three", "score_is", "0")]
    checks = spark.createDataFrame(rows, "source string, suite string, kind string, argument string")
    got = {(r.suite, r.doc_id): r.status for r in evaluate(checkable(texts, "t"), checks, by="source").collect()}
    assert got == {("one", "a"): "PASS", ("one", "b"): "FAIL", ("one", None): "FAIL", ("two", "a"): "PASS", ("two", "b"): "PASS", ("two", None): "PASS"}
    assert evaluate(checkable(texts, "t"), checks.limit(0), by="source").count() == 0


def test_request_bodies(spark):
    lines = [
        '{"text": "call 010-1234-5678"}', '{"text": "", "doc_id": "e"}', '{"doc_id": 7, "text": "n", "other": [1]}', '{"text": "\\u00e9\\n\\"q\\""}',
        '{"text": ', "plain", '{"text": "a"} x', '["text"]', '"text"', "5", "null", "{}", '{"Text": "a"}', '{"text": null}', '{"text": 5}', '{"text": ["a"]}', '{"text": {"a": 1}}', '{"text": true}', "  ",
    ]
    path = f"{run_folder(spark, 'bodies')}/in"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = [(r.doc_id, r.text, r.reject, r.body) for r in read_requests(spark, path).collect()]

    def want(line):
        try:
            body = json.loads(line)
        except ValueError:
            return (None, None, "not_json", line)
        if not isinstance(body, dict):
            return (None, None, "not_an_object", line)
        doc_id = str(body["doc_id"]) if "doc_id" in body else None
        if "text" not in body:
            return (doc_id, None, "text_missing", line)
        return (doc_id, body["text"], None, None) if isinstance(body["text"], str) else (doc_id, None, "text_not_a_string", line)

    assert sorted(got, key=str) == sorted((want(x) for x in lines if x.strip()), key=str)


def test_new_queries_equal_their_plain_forms(spark):
    fresh = rows(scrub(inputs.corpus(spark, SF_SMALL).select("doc_id", "text")))
    assert sorted(map(tuple, catalog.scrub_incremental(spark, SF_SMALL).collect())) == fresh
    once = catalog.stream_guard_once(spark, SF_SMALL)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, catalog.stream_guard(spark, SF_SMALL).collect()))


def test_hybrid_stream_waits_for_answers(spark):
    from piisift.operators.guard import hybrid_guard

    texts = inputs.corpus(spark, SF_SMALL).select("doc_id", "text")
    g = hybrid_guard(texts, catalog.document_answers(spark, SF_SMALL))
    batch = g.select("doc_id", "answer", "pii_score", "blocked", F.size("matches").alias("n_matches"), F.col("prompt_injection.details").alias("details"))
    assert sorted(map(tuple, catalog.stream_hybrid_guard(spark, SF_SMALL).collect())) == sorted(map(tuple, batch.collect()))
