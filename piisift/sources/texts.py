"""Sources (S1-S6) and sinks (K1-K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisift.config import (
    ALLOWLIST_KINDS,
    DEFAULT_ALLOWLIST,
    DOC_CAP_NOTICE,
    PAGE_HEADER,
    PAGE_SEPARATOR,
)

ALLOWLIST_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
LLM_RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("answer_no", T.IntegerType()),
    ]
)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt out to ``partitions`` tasks; by default as it is.

    Detection is map-only, so its parallelism is the scan's.  A table that
    comes in too few splits (one row group) can be dealt out first; how many
    tasks that takes is the caller's decision, never read from a size estimate.
    """
    return df.repartition(partitions) if partitions and not df.isStreaming else df


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of texts (``{"text": ...}`` request bodies or a corpus)."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Why a request body is not taken.
REJECTS = ("not_json", "not_an_object", "text_missing", "text_not_a_string")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one JSON object ``{"text": …}`` a line: ``doc_id, text, reject, body``.

    ``reject`` says why a body is not taken (one of ``REJECTS``, then ``text``
    is null and ``body`` holds the line), else it is null.  As in the service,
    the text must be a JSON string (null, numbers, lists are not), other fields
    are ignored, and an empty text is one.  ``doc_id`` is the body's, as text,
    where it has one.  Blank lines are no bodies.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    # the parser stops after the first value: inside brackets anything behind it breaks the list or is a second element
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    alone = lines.select("value", listed.alias("l")).select("value", F.when(F.try_variant_get("l", "$[1]", "variant").isNull(), F.try_variant_get("l", "$[0]", "variant")).alias("v"))
    kinds = alone.select(
        "value",
        "v",
        F.schema_of_variant("v").alias("kind"),
        F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")).alias("text_kind"),
    )
    reject = (
        F.when(F.col("v").isNull(), REJECTS[0])
        .when(~F.col("kind").startswith("OBJECT"), REJECTS[1])
        .when(F.col("text_kind").isNull(), REJECTS[2])
        .when(F.col("text_kind") != "STRING", REJECTS[3])
    )
    rows = kinds.select("value", "v", reject.alias("reject"))
    taken = F.col("reject").isNull()
    return rows.select(
        F.try_variant_get("v", "$.doc_id", "string").alias("doc_id"),
        F.when(taken, F.try_variant_get("v", "$.text", "string")).alias("text"),
        "reject",
        F.when(~taken, F.col("value")).alias("body"),
    )


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; the file path is the document id."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def allowlist_table(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """The allow-list as a small ``(kind, value)`` table (missing kind -> empty)."""
    lists = DEFAULT_ALLOWLIST if lists is None else lists
    rows = [(kind, v) for kind in ALLOWLIST_KINDS for v in (lists.get(kind) or [])]
    return spark.createDataFrame(rows, ALLOWLIST_SCHEMA)


def read_llm_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw model answers ``(doc_id, task in {'pii','injection'}, response[, answer_no])``."""
    return spark.read.format(fmt).schema(LLM_RESPONSE_SCHEMA).load(path)


def page_parts(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """``doc_id, page_no, part``: each non-empty page with its header and line end."""
    hl, hr = PAGE_HEADER.split("{n}")
    header = F.concat(F.lit(hl), F.col(page_col).cast("string"), F.lit(hr))
    return pages.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(doc_col).alias("doc_id"), F.col(page_col).alias("page_no"), F.concat(header, F.col(text_col), F.lit("\n")).alias("part")
    )


#: Pages of a document that are put together as one piece.
PIECE_PAGES = 64


def document_pieces(pages: DataFrame, piece_pages: int = PIECE_PAGES, doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """S3 for documents of any size: ``doc_id, piece, part``, the document's text in consecutive parts.

    A piece holds the non-empty pages whose numbers share ``floor(page_no /
    piece_pages)``, put together as :func:`assemble_documents` does; joined
    with the page separator in the order of ``piece`` they are the document.
    No task sees more than a piece, and text is exchanged once.  Pages that
    repeat a number come in the order of their texts; a null page number comes
    first, a null ``doc_id`` is a document; no rows without non-empty pages.
    """
    parts = page_parts(pages, doc_col, page_col, text_col)
    grouped = parts.groupBy("doc_id", F.floor(F.col("page_no") / piece_pages).alias("piece"))
    ordered = grouped.agg(F.array_sort(F.collect_list(F.struct("page_no", "part"))).alias("_parts"))
    return ordered.select("doc_id", "piece", F.array_join(F.transform("_parts", lambda p: p["part"]), PAGE_SEPARATOR).alias("part"))


def piece_offsets(pieces: DataFrame, chars: Column, group: int = PIECE_PAGES) -> DataFrame:
    """``doc_id, piece, offset, chars``: where each piece begins in its document's text (characters, from 0).

    Prefix sums in two levels: within groups of ``group`` pieces and over the
    groups, so a document's rows spread over its groups.  Only the sizes move.
    """
    rows = pieces.select("doc_id", "piece", chars.cast("long").alias("chars"), F.floor(F.col("piece") / group).alias("_group"))
    step = F.sum(F.col("chars") + len(PAGE_SEPARATOR))
    earlier = Window.partitionBy("doc_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("doc_id", "_group").agg(step.alias("_size")).withColumn("_base", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    groups = groups.select(F.col("doc_id").alias("_d"), F.col("_group").alias("_g"), "_base")
    inside = Window.partitionBy("doc_id", "_group").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(step.over(inside), F.lit(0)))
    rows = rows.join(groups, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_group").eqNullSafe(F.col("_g")))
    return rows.select("doc_id", "piece", (F.col("_base") + F.col("_within")).alias("offset"), "chars")


def assemble_documents(
    pages: DataFrame,
    max_length: int | None = None,
    doc_col: str = "doc_id",
    page_col: str = "page_no",
    text_col: str = "text",
    salt_buckets: int = 64,
) -> DataFrame:
    """S3 + S4: pages -> one text per document, whole unless ``max_length`` is given.

    Each non-empty page becomes ``"[페이지 n]\n{text}\n"`` (``n`` is the page
    number, so numbering survives skipped pages); parts are joined with
    ``"\n"``.  Longer than ``max_length``: the first ``max_length`` characters
    plus the fixed notice.

    Scale (capped): a part is at least ``MIN_PART`` characters, so only a
    document's first ``K = max_length // MIN_PART + 1`` non-empty pages can
    start inside the cap.  Stage 1 salts pages by page number and keeps, per
    (document, salt), the K smallest pages plus that salt's length total, so a
    document holding a huge share of all pages is spread over ``salt_buckets``
    tasks.  Stage 2 sees at most ``salt_buckets * K`` rows per document: exact
    running offsets, the full length from the salt totals, and only parts
    starting inside the cap are collected (at most the cap plus one page).
    """
    hl, hr = PAGE_HEADER.split("{n}")
    parts = page_parts(pages, doc_col, page_col, text_col)
    sep = len(PAGE_SEPARATOR)
    if max_length is None:
        # Whole documents: the output row is the document itself.
        agg = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "part"))).alias("_parts"))
        return agg.select("doc_id", F.array_join(F.transform("_parts", lambda p: p["part"]), PAGE_SEPARATOR).alias("text"))

    min_part = len(hl) + 1 + len(hr) + 1 + 1 + sep  # header with one digit, one text char, newline, separator
    keep = max_length // min_part + 1
    plen = F.length("part") + sep
    # No part contributes more than the cap, so no exchange moves more of it.
    cut = parts.withColumn("_plen", plen).withColumn("part", F.substring("part", 1, max_length + 1))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("page_no"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("doc_id", "_salt").orderBy("page_no")
    stage1 = (
        salted.withColumn("_rn1", F.row_number().over(w1))
        .withColumn("_salt_total", F.sum("_plen").over(w1.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .filter(F.col("_rn1") <= keep)
    )
    w2 = Window.partitionBy("doc_id").orderBy("page_no")
    stage2 = (
        stage1.withColumn("_rn", F.row_number().over(w2))
        .withColumn("_end", F.sum("_plen").over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn(
            "_total",
            F.sum(F.when(F.col("_rn1") == 1, F.col("_salt_total"))).over(w2.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        )
        .filter((F.col("_rn") <= keep) & (F.col("_end") - F.col("_plen") <= max_length))
    )
    agg = stage2.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "part"))).alias("_parts"),
        (F.max("_total") - sep).alias("_full_length"),
    )
    # The kept parts cover the first ``max_length`` characters of the full text.
    joined = F.array_join(F.transform("_parts", lambda p: p["part"]), PAGE_SEPARATOR)
    capped = F.when(
        F.col("_full_length") > max_length, F.concat(F.substring(joined, 1, max_length), F.lit(DOC_CAP_NOTICE))
    ).otherwise(joined)
    return agg.select("doc_id", capped.alias("text"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1/K2: result or scrubbed-corpus sink (JSON keeps non-ASCII as is)."""
    df.write.mode(mode).format(fmt).save(path)


def wire_matches(matches: Column) -> Column:
    """Matches in the response shape: ``{type, value, span: [start, end], confidence, source}``."""
    return F.transform(
        matches,
        lambda m: F.struct(
            m["ptype"].alias("type"),
            m["value"].alias("value"),
            F.array(m["span_start"], m["span_end"]).alias("span"),
            m["confidence"].alias("confidence"),
            m["source"].alias("source"),
        ),
    )


def guard_response(guarded: DataFrame) -> DataFrame:
    """K1: one JSON response per guarded text (``answer, pii_score, blocked,
    matches, prompt_injection``), non-ASCII kept as is."""
    body = F.struct(
        F.col("answer").alias("answer"),
        F.col("pii_score").alias("pii_score"),
        F.col("blocked").alias("blocked"),
        wire_matches(F.col("matches")).alias("matches"),
        F.col("prompt_injection").alias("prompt_injection"),
    )
    return guarded.select("doc_id", F.to_json(body).alias("response"))


def scrub_response(scrubbed: DataFrame) -> DataFrame:
    """K1: one JSON response per scrubbed text (``scrubbed, matches``)."""
    body = F.struct(F.col("scrubbed").alias("scrubbed"), wire_matches(F.col("matches")).alias("matches"))
    return scrubbed.select("doc_id", F.to_json(body).alias("response"))
