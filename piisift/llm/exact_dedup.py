"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition sorts its digests into a run and combines equal ones
(the map side of a sort aggregate).  Runs are then exchanged in binomial
rounds: a run's lane has one digit per round, and in round *r* the lanes that
differ only in digit *r* trade digest ranges, so that each receives ``2^bits``
sorted runs, merges them and keeps one verified identifier per digest.  After
the last round a lane holds one digest range, merged over all runs.  No task
ever holds more than its digest range, and a text that makes up a third of all
rows is one row per run before it moves.

Two rows are equal when SHA-256, byte length and an independent 64-bit hash of
the text agree, so an identifier is kept only for a verified class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import cut, unused

#: Repeated texts (about 100 bytes each) up to which their list is broadcast; beyond, the joins exchange both sides.
BROADCAST_ROWS = 200_000
CLASS = ["text_sha256", "_bytes", "_check"]


def _class_columns(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("_bytes"),
        F.xxhash64(text).alias("_check"),
    ]


def _better(doc_id: Column, row: Column, keep: str) -> Column:
    """A struct whose maximum (``largest``) or minimum (``smallest``) is the row that stays; null ids lose."""
    return F.struct((doc_id.isNotNull() if keep == "largest" else doc_id.isNull()).alias("n"), doc_id.alias("id"), row.alias("row"))


def merge_runs(thin: DataFrame, keep: str = "largest", bits: int = 3, rounds: int = 2) -> DataFrame:
    """One row per distinct text: the class columns, ``best`` (id and row that stay) and ``group_size``.

    ``thin`` has the class columns, ``doc_id``, ``_row`` and ``_lane`` (the
    run's number).  Each round is one exchange; rows only get fewer.
    """
    pick = F.max if keep == "largest" else F.min
    radix = 1 << bits
    lane = [F.pmod(F.floor(F.col("_lane") / radix**r), F.lit(radix)).cast("int").alias(f"_l{r}") for r in range(rounds)]
    runs = thin.select(*CLASS, _better(F.col("doc_id"), F.col("_row"), keep).alias("best"), F.lit(1).cast("long").alias("group_size"), *lane)
    for r in range(rounds):
        # digit r of the lane becomes digit r of the digest: the hex character holds `bits` <= 4 bits
        digit = F.pmod(F.conv(F.substring("text_sha256", r + 1, 1), 16, 10).cast("int"), F.lit(radix))
        runs = (
            runs.withColumn(f"_l{r}", digit)
            .groupBy(*[f"_l{i}" for i in range(rounds)], *CLASS)
            .agg(pick("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    return runs.select(*CLASS, "best", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty and form one class with empty texts.  ``keep`` is
    ``largest`` or ``smallest`` id; rows with a null id stay only in a class
    without any id.  Of repeated rows (same id and text) exactly one is kept.
    An empty table gives an empty result; other columns are not read.
    """
    thin = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *_class_columns(F.col(text_col)),
            F.monotonically_increasing_id().alias("_row"),
            F.spark_partition_id().alias("_lane"),
        )
    )
    groups = merge_runs(thin, keep)
    return thin.join(groups, CLASS).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row per distinct text, all columns kept.

    Of equal texts the row with the ``largest`` (or ``smallest``) id stays; of
    rows that repeat that id and text one stays.  Null texts equal empty ones.
    """
    names = unused(docs.columns, "sha", "bytes", "check", "id")
    marked = docs.select("*", *[c.alias(n) for c, n in zip(_class_columns(F.col(text_col)), names, strict=False)], F.col(id_col).alias(names[3]))
    thin = marked.select(
        *[F.col(n).alias(c) for n, c in zip(names, [*CLASS, "doc_id"], strict=True)],
        F.lit(0).alias("_row"),
        F.spark_partition_id().alias("_lane"),
    )
    kept = merge_runs(thin, keep).where("group_size > 1")
    others = unused([*docs.columns, *names], *[f"kept_{n}" for n in names])
    kept = cut(kept.select(*[F.col(c).alias(n) for c, n in zip(CLASS, others, strict=False)], F.col("best.id").alias(others[3])))
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)  # then only the rows that stay of repeated texts are exchanged
    same = [F.col(n).eqNullSafe(F.col(o)) for n, o in zip(names, others, strict=True)]
    text = same[0] & same[1] & same[2]
    alone = marked.join(kept, text, "left_anti")
    stay = marked.join(kept, text & same[3], "left_semi").dropDuplicates(names)
    return alone.union(stay).select(*docs.columns)
