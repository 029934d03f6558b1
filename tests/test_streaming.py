"""Streaming guard/scrub equal the batch results."""

from conftest import SF_SMALL
from piisift.plans import catalog


def test_stream_equals_batch(spark):
    streamed = {r.doc_id: tuple(r) for r in catalog.stream_guard(spark, SF_SMALL).collect()}
    batch_df = catalog.guard(catalog.inputs.corpus(spark, SF_SMALL).select("doc_id", "text"))
    batch = {r.doc_id: (r.doc_id, r.answer, r.pii_score, r.blocked, len(r.matches)) for r in batch_df.collect()}
    assert streamed == batch
    scrubbed = catalog.stream_scrub(spark, SF_SMALL).collect()
    assert len(scrubbed) == len(batch)


def test_restart_resumes_exactly_once(spark):
    import tempfile

    from piisift.streaming.jobs import document_stream, guard_stream, start_sink

    base = tempfile.mkdtemp(prefix="piisift-stream-", dir="/tmp")
    src, out = f"{base}/in", f"{base}/out"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    first.write.parquet(src)
    q = start_sink(guard_stream(document_stream(spark, src, glob="*.parquet")), out, "restart_a")
    q.awaitTermination()
    n1 = spark.read.parquet(f"{out}/data").count()
    second.write.mode("append").parquet(src)
    # Same checkpoint: a restarted query only picks up the new files.
    q = start_sink(guard_stream(document_stream(spark, src, glob="*.parquet")), out, "restart_b")
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/data")
    assert n1 == first.count()
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()


def test_hybrid_guard_on_a_stream_equals_batch(spark):
    import tempfile

    from pyspark.sql import functions as F

    from piisift.operators.guard import hybrid_guard
    from piisift.streaming.jobs import document_stream, start_sink

    responses = catalog.pii_responses(spark, SF_SMALL)  # static table joined to the stream
    streamed_df = hybrid_guard(document_stream(spark, SF_SMALL), responses).select(
        "doc_id", "pii_score", "blocked", F.size("matches").alias("n")
    )
    out = tempfile.mkdtemp(prefix="piisift-hybrid-", dir="/tmp")
    q = start_sink(streamed_df, out, "hybrid_stream_test")
    q.awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(f"{out}/data").collect()))
    batch_texts = catalog.inputs.corpus(spark, SF_SMALL).select("doc_id", "text")
    batch = hybrid_guard(batch_texts, responses).select("doc_id", "pii_score", "blocked", F.size("matches").alias("n"))
    assert streamed == sorted(map(tuple, batch.collect()))
    assert any(r[3] > 0 for r in streamed)


def test_table_that_is_a_folder(spark):
    import tempfile

    base = tempfile.mkdtemp(prefix="piisift-folder-", dir="/tmp")
    rows = [(i, f"call 010-1234-{i:04d}", "en", "web", 18) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    for query in (catalog.stream_guard, catalog.stream_scrub):
        got = query(spark, base).collect()
        assert sorted(r.doc_id for r in got) == sorted(f"doc-{i}" for i in range(40))
        assert all(r.n_matches == 1 for r in got)
