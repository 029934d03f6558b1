"""Long-form (one row per match) operators: allow-list anti-join and the merge of match rows.

Row form keeps a text's matches in one array and needs no shuffle; these are
for matches that come as rows, from a joined table or from texts that are
stored in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piisift.functions.matches import MATCH_FIELDS, merge_matches
from piisift.operators.allowlist import typed_allowlist

#: Characters of a text whose match rows are put in order by one task.
PART_CHARS = 1 << 16


def filter_allowlisted(long_df: DataFrame, allow: DataFrame) -> DataFrame:
    """V4 as an anti-join on ``(ptype, value)``; how it runs (broadcast, sort-merge, skewed
    partitions split) is the adaptive planner's choice."""
    return long_df.join(typed_allowlist(allow), on=["ptype", "value"], how="left_anti")


def with_islands(long_df: DataFrame, keys: list[str], part_chars: int = PART_CHARS) -> DataFrame:
    """Match rows with ``_island``: the start of the island they belong to.

    A row that starts at or after every earlier end of its text (by start, end,
    ordinal) opens an island; islands never interact.  Rows are dealt by ranges
    of ``part_chars`` positions, so one text's rows spread over many tasks.  In
    a part, rows are ordered by a window; of each part one thin row goes on,
    with its greatest end and its last opening.  The running maximum of the
    ends tells a part how far earlier matches reach, and rows before that point
    belong to the last island opened before.
    """
    part = [*keys, "_part"]
    rows = long_df.withColumn("_part", F.floor(F.col("span_start") / part_chars))
    order = Window.partitionBy(*part).orderBy("span_start", "span_end", "ord")
    before = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_open", F.when(before.isNull() | (F.col("span_start") >= before), F.col("span_start")))
    rows = rows.withColumn("_local", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*part).agg(F.max("span_end").alias("_end"), F.max("_local").alias("_last"))
    parts = parts.withColumn("_reach", F.max("_end").over(earlier))
    opened = F.when(F.col("_reach").isNull() | (F.col("_last") >= F.col("_reach")), F.col("_last"))
    parts = parts.withColumn("_opened", opened).withColumn("_carried", F.max("_opened").over(earlier))
    parts = parts.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], "_reach", "_carried")
    same = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)]
    island = F.when(F.col("_local") < F.col("_reach"), F.col("_carried")).otherwise(F.col("_local"))
    return rows.join(parts, same).select(*long_df.columns, island.alias("_island"))


def merge_long(long_df: DataFrame, keys: list[str], part_chars: int = PART_CHARS) -> DataFrame:
    """M1-M3 over match rows, exact: the ordered fold runs per (text, island).

    Neither a text's rows nor its islands meet in one task; an island's do
    (matches that overlap each other in a chain).
    """
    fields = [f.name for f in MATCH_FIELDS]
    grouped = with_islands(long_df, keys, part_chars).groupBy(*keys, "_island").agg(F.collect_list(F.struct(*fields)).alias("_ms"))
    merged = grouped.select(*keys, F.explode(merge_matches(F.col("_ms"))).alias("m"))
    return merged.select(*keys, *[F.col(f"m.{f}").alias(f) for f in fields])
