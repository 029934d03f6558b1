"""Streaming guard and scrub.

Plain guard and scrub are stateless: the batch expressions run unchanged on a
streaming DataFrame.  Two jobs keep state under a watermark: one drops requests
that are sent again, one waits for model answers that come after their text.
Sinks are parquet tables under the shared ``spark.checkpoint.dir`` with their
own streaming checkpoint, so a restarted query (or a lost executor) resumes
exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisift.config import DetectorConfig
from piisift.operators.detect import DEFAULT_CONFIG
from piisift.operators.guard import guard, guard_with_answers, parsed_answers, scrub
from piisift.session import run_folder

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, glob: str = "documents*.parquet"
) -> DataFrame:
    """The ``documents`` parquet files of a directory, or the files in folders of that name, as a stream of (doc_id, text)."""
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # in the path, not as a filter of names: the files of a table that is a folder are named otherwise
    s = reader.parquet(f"{sf_dir.rstrip('/')}/{glob}")
    return s.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), "text")


def start_sink(df: DataFrame, out_dir: str, name: str, available_now: bool = True, trigger: str = "10 seconds"):
    """File sink with its own checkpoint; ``availableNow`` drains what exists and stops, else ``trigger`` paces the batches."""
    writer = (
        df.writeStream.format("parquet")
        .option("path", f"{out_dir}/data")
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
        .queryName(name)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def drain(stream: DataFrame, out_dir: str, name: str) -> None:
    """Runs a stream over what its source holds now; raises what stopped it."""
    q = start_sink(stream, out_dir, name)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out_dir = run_folder(spark, name)
    drain(stream, out_dir, out_dir.rsplit("/", 1)[-1])
    return spark.read.parquet(f"{out_dir}/data")


def guard_stream(stream: DataFrame, config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    g = guard(stream, "text", config)
    return g.select("doc_id", "answer", "pii_score", "blocked", F.size("matches").alias("n_matches"))


def scrub_stream(stream: DataFrame, config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    s = scrub(stream, "text", config)
    return s.select("doc_id", "scrubbed", F.size("matches").alias("n_matches"))


def run_stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, guard_stream(document_stream(spark, sf_dir)), "stream_guard")


def run_stream_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, scrub_stream(document_stream(spark, sf_dir)), "stream_scrub")


def first_requests(stream: DataFrame, within: str = "1 hour", time_col: str = "sent_at") -> DataFrame:
    """Each ``doc_id`` once, though requests are sent again (with their first ``sent_at``) and queries restart.

    Ids are kept as state until the watermark, ``within`` behind the latest
    request, passes them; a repetition that comes later than that is dropped as
    late.  Rows without an id count as one id; rows without a time are dropped.
    """
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["doc_id"])


def guard_once_stream(stream: DataFrame, within: str = "1 hour", config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    """J4 with each request answered once."""
    return guard_stream(first_requests(stream, within).select("doc_id", "text"), config)


def hybrid_guard_stream(texts: DataFrame, answers: DataFrame, wait: str = "10 minutes", late: str = "1 minute", config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    """J10 on streams: model answers may come up to ``wait`` after their text.

    ``texts`` are ``(doc_id, text, sent_at)``, ``answers`` ``(doc_id, task,
    response, answer_no, answered_at)``; either may be ``late`` out of order.  A
    left join keeps a text until the watermark passes ``sent_at + wait``, then
    its answers are grouped and it is guarded with them, or with the default
    verdict if there are none.  Answers to no text, or after the wait, are
    dropped.  Texts that share ``doc_id``, time and content are one.
    """
    texts = texts.select("doc_id", "text", "sent_at").withWatermark("sent_at", late)
    answers = parsed_answers(answers.select(F.col("doc_id").alias("_doc"), "task", "response", "answer_no", "answered_at"))
    answers = answers.withWatermark("answered_at", late)
    in_time = (F.col("answered_at") >= F.col("sent_at")) & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"INTERVAL {wait}"))
    met = texts.join(answers, (F.col("doc_id") == F.col("_doc")) & in_time, "leftOuter")
    held = met.groupBy(F.window("sent_at", "1 second"), "doc_id", "text").agg(F.collect_list("_pii").alias("_pii"), F.collect_list("_injection").alias("_injection"))
    g = guard_with_answers(held.select("doc_id", "text", "_pii", "_injection"), config=config)
    return g.select("doc_id", "answer", "pii_score", "blocked", F.size("matches").alias("n_matches"), F.col("prompt_injection.details").alias("details"))


REQUEST_SCHEMA = "doc_id string, text string, sent_at timestamp"
ANSWER_SCHEMA = "doc_id string, task string, answer_no int, response string, answered_at timestamp"


#: Closing rows, one a run: the watermark moves when a batch ends, and each of the two stateful operators lets go one batch later.
CLOSING = 2


def _append(rows: DataFrame, folder: str, order: int) -> None:
    """Rows as files whose time of change tells the stream their order."""
    rows.write.mode("append").parquet(f"{folder}/part={order}")


def _requests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def _timed(docs: DataFrame, name: str) -> DataFrame:
    """Requests made of documents, one a second in the order of their ids."""
    return docs.withColumn(name, F.timestamp_seconds(F.lit(1_700_000_000) + F.substring_index("doc_id", "-", -1).cast("long")))


def run_stream_guard_once(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The stream in two runs; the second finds new requests and half of the first ones again."""
    folder = run_folder(spark, "stream_guard_once")
    number = F.substring_index("doc_id", "-", -1).cast("long")
    half = docs.agg(F.max(number).alias("m")).first()["m"] // 2
    rows = _timed(docs.select("doc_id", "text"), "sent_at")
    _append(rows.where(number <= half), f"{folder}/in", 1)
    stream = guard_once_stream(_requests(spark, f"{folder}/in", REQUEST_SCHEMA))
    drain(stream, f"{folder}/out", "guard_once_1")
    _append(rows.where((number > half) | (number % 2 == 0)), f"{folder}/in", 2)
    drain(stream, f"{folder}/out", "guard_once_2")
    return spark.read.parquet(f"{folder}/out/data")


def run_stream_hybrid_guard(spark: SparkSession, docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Texts in one run of the stream, their answers in the next; closing rows on both sides let the waits end."""
    folder = run_folder(spark, "stream_hybrid_guard")
    texts = _timed(docs.select("doc_id", "text"), "sent_at")
    late = _timed(answers.select("doc_id", "task", "answer_no", "response"), "answered_at").withColumn("answered_at", F.col("answered_at") + F.expr("INTERVAL 5 minutes"))
    _append(texts, f"{folder}/texts", 1)
    _append(late.limit(0), f"{folder}/answers", 1)
    stream = hybrid_guard_stream(_requests(spark, f"{folder}/texts", REQUEST_SCHEMA), _requests(spark, f"{folder}/answers", ANSWER_SCHEMA))
    drain(stream, f"{folder}/out", "hybrid_guard_1")
    _append(late, f"{folder}/answers", 2)
    drain(stream, f"{folder}/out", "hybrid_guard_2")
    for i in range(CLOSING):  # a null answer would be left out before it moves the watermark
        at = F.timestamp_seconds(F.lit(4_000_000_000 + 86_400 * i))
        closing = spark.range(1).select(F.lit(f"end-{i}").alias("doc_id"), F.lit("").alias("text"), at.alias("sent_at"))
        _append(closing, f"{folder}/texts", 3 + i)
        _append(closing.select("doc_id", F.lit("injection").alias("task"), F.lit(0).alias("answer_no"), F.lit("{}").alias("response"), at.alias("answered_at")), f"{folder}/answers", 3 + i)
        drain(stream, f"{folder}/out", f"hybrid_guard_{3 + i}")
    return spark.read.parquet(f"{folder}/out/data").where(~F.col("doc_id").startswith("end-"))
