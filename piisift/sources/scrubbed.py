"""K2: a scrubbed corpus on disk that follows its source: only what changed is scrubbed and written again.

The corpus is a Parquet table in ``buckets`` folders by a hash of ``doc_id``.
Each row carries a digest of its source text and of the rules that scrubbed
it; these digests are the manifest.  An update compares them with those of the
source (thin rows), scrubs the rows that have none, takes the others of the
same bucket as they are, and overwrites the buckets that changed, no others.
An update that is cut short leaves whole buckets, old or new; the next one
finishes it.  One update runs at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisift.config import DetectorConfig
from piisift.operators.detect import DEFAULT_CONFIG
from piisift.operators.guard import scrub
from piisift.session import checkpoint_dir

KEY = ["bucket", "doc_id", "digest"]
COLUMNS = ["doc_id", "digest", "scrubbed", "matches", "bucket"]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _same(left: DataFrame, right: DataFrame):
    """Equality on the key where a null id equals itself."""
    return [left[c].eqNullSafe(right[f"_{c}"]) for c in KEY]


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") if c in KEY else F.col(c) for c in df.columns])


def read_scrubbed(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, scrubbed, matches`` of the corpus at ``path``."""
    return spark.read.parquet(path).where(F.col("digest").isNotNull()).select("doc_id", "scrubbed", "matches")


def update_scrubbed(docs: DataFrame, path: str, config: DetectorConfig = DEFAULT_CONFIG, buckets: int = 256, text_col: str = "text") -> list[int]:
    """Brings the scrubbed corpus at ``path`` to ``docs`` (``doc_id`` and text); the buckets that were written.

    New, changed and removed rows count, and a change of the rules changes all.
    Rows that repeat an id are kept each, as many as the source has; a null
    text stays null; a null id is an id.  ``buckets`` must be that of the first
    update.  Only bucket numbers reach the driver.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rules = json.dumps([config.rules(), asdict(config)], ensure_ascii=True, sort_keys=True)
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")
    text = F.col(text_col)
    digest = F.sha2(F.concat(F.lit(rules), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))), 256)
    source = docs.select(F.col("doc_id"), text.alias("text"), digest.alias("digest"), bucket.alias("bucket"))
    now = source.groupBy(*KEY).agg(F.count("*").alias("n"))
    old = _stored(spark, path)
    if old is None:
        changed = None
        made = scrub(source, config=config)
    else:
        had = old.where(F.col("digest").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("m"), F.first(F.struct("scrubbed", "matches")).alias("kept"))
        counts = _renamed(had.select(*KEY, "m"))
        differ = now.join(counts, _same(now, counts), "full").where(~F.col("n").eqNullSafe(F.col("m")))
        changed = sorted(r["b"] for r in differ.select(F.coalesce("bucket", "_bucket").alias("b")).distinct().collect())
        if not changed:
            return []
        here, had = source.where(F.col("bucket").isin(changed)), _renamed(had.where(F.col("bucket").isin(changed)))
        fresh = scrub(here.join(had.select("_bucket", "_doc_id", "_digest"), _same(here, had), "left_anti"), config=config)
        thin = here.select(*KEY)
        kept = thin.join(had, _same(thin, had)).select("doc_id", "digest", "kept.scrubbed", "kept.matches", "bucket")
        # a bucket whose rows are all gone is overwritten by one row without a digest
        left = now.select("bucket").distinct()
        gone = spark.createDataFrame([(b,) for b in changed], "bucket int").join(left, "bucket", "left_anti")
        types = {f.name: f.dataType for f in kept.schema.fields}
        gone = gone.select(*[F.lit(None).cast(types[c]).alias(c) for c in COLUMNS[:-1]], "bucket")
        made = fresh.select(*COLUMNS).unionByName(kept).unionByName(gone).checkpoint(eager=True)  # the table is read until here, then written
    written = made.select(*COLUMNS).repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic")
    written.mode("overwrite").parquet(path)
    return changed if changed is not None else list(range(buckets))
