"""The registered query of each operator: the operator over its whole table, digest columns derived from its output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piisift.functions.arrays import let
from piisift.llm.bitplanes import cluster_vectors
from piisift.llm.common import WORD, table
from piisift.llm.exact_dedup import exact_groups
from piisift.llm.extraction import extract_text
from piisift.llm.jaccard import similar_groups
from piisift.llm.labelled import remainder
from piisift.llm.mixing import mix_sources
from piisift.llm.mixlm import score_texts
from piisift.llm.packing import pack_documents
from piisift.llm.periodic import find_runs
from piisift.llm.quality import quality_model, score_quality
from piisift.llm.suffix_dedup import remove_repeats
from piisift.llm.topk import top_k
from piisift.llm.toxicity import score_toxicity, toxicity_model
from piisift.llm.winnowing import as_text, fingerprint_edits


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=4, threshold=(85, 100))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def _verdicts(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", predicted.alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return _verdicts(score_toxicity(docs, model), 3, 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return _verdicts(score_quality(docs, model), 4, 2)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 10) == 0
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text of every tenth id (by crc32) with its words from some place on replaced by a repeated passage."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        return let(F.array(a, p), lambda x: F.concat(F.slice(words, F.lit(1), x[0]), F.transform(F.sequence(x[0], n - 1), lambda i: F.get(words, x[0] + F.pmod(i - x[0], x[1])))))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    tail = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(""))
    return F.when((h % 10 == 0) & text.isNotNull(), tail).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", _with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text")), minimum=24, repeats=3)
    # runs are ordered by start, then period, so the first of equal exponents stays
    best = F.aggregate(F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    digests = [F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *digests)
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, clusters = cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, scale=64, dim=64)
    clusters = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))
    return found.join(F.broadcast(clusters), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(table(spark, sf_dir, "documents"), part=4)
    prints = [as_text(F.col(c)).alias(n) for c, n in (("prints", "fingerprint"), ("edited_prints", "edited_fingerprint"))]
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), digest, *prints, "near_edited", "near_next")


QUERIES = {f.__name__: f for f in (op1_pack_documents, op2_ngram_jaccard, op3_mix_sources, op4_extract_html, op5_exact_dedup, op6_exact_topk, op7_toxicity, op8_quality, op9_suffix_dedup, op10_lm_scoring, op11_periodic_runs, op12_centroid_clusters, op13_fingerprints)}
