"""Expectations as a table, evaluated over detection results.

A check is a row ``(suite, kind, argument)`` for one document or for all of one
source; adding a row adds a check.  A document passes a suite when all of the
suite's checks hold for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.config import DetectorConfig
from piisift.functions.matches import mask_text, risk_value, score_from_risk
from piisift.operators.detect import DEFAULT_CONFIG, detect


def checkable(texts: DataFrame, source: str, config: DetectorConfig = DEFAULT_CONFIG) -> DataFrame:
    """``doc_id, source, score, blocked, matches, masked, delta``: what checks are evaluated on (no delta)."""
    d = detect(texts, config=config, internal=True)
    score = score_from_risk(risk_value(F.col("matches"), config.weights, config.default_weight))
    d = d.select("doc_id", F.lit(source).alias("source"), score.alias("score"), "matches", mask_text(F.col("text"), F.col("matches")).alias("masked"))
    blocked = (F.col("score") >= config.block_threshold).alias("blocked")
    return d.select("doc_id", "source", "score", blocked, "matches", "masked", F.lit(None).cast("int").alias("delta"))


def holds(check: Column) -> Column:
    """Whether one check ``struct<kind, argument>`` holds for the row; an unknown kind or an argument of another form does not."""
    kind, argument = check["kind"], check["argument"]
    number = argument.try_cast("double")
    has_type = F.exists("matches", lambda m: m["ptype"] == argument)
    has_value = F.exists("matches", lambda m: m["value"] == argument)
    found = (
        F.when(kind == "type_present", has_type)
        .when(kind == "type_absent", ~has_type)
        .when(kind == "value_present", has_value)
        .when(kind == "value_absent", ~has_value)
        .when(kind == "masked_contains", F.col("masked").contains(argument))
        .when(kind == "masked_lacks", ~F.col("masked").contains(argument))
        .when(kind == "blocked_or_masked_contains", F.col("blocked") | F.col("masked").contains(argument))
        .when(kind == "blocked_is", F.col("blocked").cast("string") == argument)
        .when(kind == "matches_are", F.size("matches") == number)
        .when(kind == "score_is", F.col("score") == number)
        .when(kind == "score_above", F.col("score") > number)
        .when(kind == "score_at_most", F.col("score") <= number)
        .when(kind == "delta_at_most", F.col("delta") <= number)
    )
    return F.coalesce(found, F.lit(False))


def evaluate(results: DataFrame, checks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``suite, doc_id, status``: each suite of the row's document (``by="doc_id"``) or source (``by="source"``).

    ``checks`` has the columns ``by``, ``suite``, ``kind`` and ``argument``.  The
    checks of one document (or source) travel together; rows without checks have
    no status, checks without rows neither.  ``doc_id`` null has none.
    """
    grouped = checks.groupBy(F.col(by).alias("_by"), "suite").agg(F.collect_list(F.struct("kind", "argument")).alias("_checks"))
    met = results.join(grouped, F.col(by) == F.col("_by"))
    return met.select("suite", "doc_id", F.when(F.forall("_checks", holds), "PASS").otherwise("FAIL").alias("status"))
