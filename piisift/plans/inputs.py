"""Text tables the registered queries run on, read from the driver tables.

``documents``, ``conversations`` and ``pages`` (raw HTML) carry real text.  The corpus has no
resident numbers, accounts, addresses or ID numbers, so a few stand-in texts
are composed from other tables' columns (only to give rows of schema
``(doc_id string, text string)``; the jobs never see how they were made and
work the same on any text).  ``piisift.plans.oracle`` composes the same texts
in SQL.

Every table grows with the scale factor of the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piisift.sources.texts import spread


def _spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Dealt out to ``spark.piisift.inputPartitions`` tasks if that is set (single-file inputs), else as the scan gives it."""
    wanted = spark.conf.get("spark.piisift.inputPartitions", None)
    return spread(df, int(wanted) if wanted else None)


#: Tasks per core that texts are dealt out to.
TASKS_PER_CORE = 4


def dealt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Dealt out to ``spark.piisift.inputPartitions`` tasks, else to ``TASKS_PER_CORE`` per core.

    Texts made of the columns of small tables take far more time per byte than
    a split allows for: a million customers come in one row group, so one task
    would search all their sheets.
    """
    wanted = spark.conf.get("spark.piisift.inputPartitions", None)
    return spread(df, int(wanted) if wanted else TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(col: Column, n: int) -> Column:
    return F.lpad(col.cast("string"), n, "0")


def _key(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (doc_id, text), plus lang and source for reports."""
    d = _read(spark, sf_dir, "documents")
    return d.select(_key("doc-", F.col("doc_id")).alias("doc_id"), "text", "lang", "source")


def _conversation_turns(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    if role is not None:
        c = c.filter(F.col("role") == role)
    doc_id = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return c.select(doc_id.alias("doc_id"), "text")


def _web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as (doc_id, text): raw HTML is scanned as it is."""
    p = _read(spark, sf_dir, "pages")
    return p.select(_key("page-", F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))


def _customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer sheet: name context, ID keyword and code, mobile, e-mail, account, card."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    surname = F.element_at(F.array(*[F.lit(x) for x in ("김", "이", "박", "최", "정")]), (k % 5 + 1).cast("int"))
    text = F.concat(
        F.lit("성함은 "), surname, F.lit("민수님, "),
        F.lit("고객번호: C"), _pad(k, 6),
        F.lit(" 연락처 010-"), _pad(k % 10000, 4), F.lit("-"), _pad(k * 7 % 10000, 4),
        F.lit(", 이메일 "), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"),
        F.lit(", 계좌번호 "), _pad(k % 1000, 3), F.lit("-"), _pad(F.col("c_nationkey"), 2), F.lit("-"),
        _pad(k * 37 % 1000000, 6),
        F.lit(", 카드 4"), _pad(k * 7919 % 1000000000000000, 15),
        F.lit(" 코드 KR"), _pad(k, 6),
    )
    return c.select(_key("cust-", k).alias("doc_id"), text.alias("text"))


def _order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resident-number-shaped notes (a minority pass the checksum)."""
    o = _read(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("주민 "), F.date_format("o_orderdate", "yyMMdd"), F.lit("-"),
        (F.col("o_custkey") % 4 + 1).cast("string"), _pad(F.col("o_orderkey") % 100000, 5),
        (F.col("o_custkey") % 10).cast("string"), F.lit(" 확인"),
    )
    return o.select(_key("ord-", F.col("o_orderkey")).alias("doc_id"), text.alias("text"))


def _supplier_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile and landline numbers."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("연락처 010-"), _pad(k % 10000, 4), F.lit("-"), _pad(k * 7 % 10000, 4),
        F.lit(" 사무실 02-"), _pad(k % 1000, 3), F.lit("-"), _pad(k * 13 % 10000, 4),
    )
    return s.select(_key("supp-", k).alias("doc_id"), text.alias("text"))


def _part_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street addresses with a postal code."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    city = F.element_at(F.array(*[F.lit(x) for x in ("서울시", "부산시", "대전시", "제주도")]), (k % 4 + 1).cast("int"))
    street = F.element_at(F.array(*[F.lit(x) for x in ("중앙로", "역삼동", "해운대길", "연동")]), (k * 7 % 4 + 1).cast("int"))
    text = F.concat(
        city, F.lit(" "), street, F.lit(" "), F.col("p_size").cast("string"), F.lit("번지 우편 "), _pad(k % 100000, 5)
    )
    return p.select(_key("part-", k).alias("doc_id"), text.alias("text"))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text table above, unioned: the general detection input."""
    parts = [
        _corpus(spark, sf_dir).select("doc_id", "text"),
        _conversation_turns(spark, sf_dir),
        _web_pages(spark, sf_dir),
        _customer_records(spark, sf_dir),
        _order_notes(spark, sf_dir),
        _supplier_contacts(spark, sf_dir),
        _part_addresses(spark, sf_dir),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dealt(spark, out)


# Each table on its own; those that hold no text are as the scan gives them (see :func:`dealt`).


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, _corpus(spark, sf_dir))


def conversation_turns(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    return _spread(spark, _conversation_turns(spark, sf_dir, role))


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_records(spark, sf_dir)


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_notes(spark, sf_dir)


def supplier_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_contacts(spark, sf_dir)


def part_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_addresses(spark, sf_dir)


def extended_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list table ``(kind, value)``: building-segment customers' mobiles and
    e-mails and suppliers' mobiles with a negative balance (the shipped list is
    added by the caller)."""
    c = _read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    k = F.col("c_custkey")
    phones_c = c.select(
        F.lit("phones").alias("kind"),
        F.concat(F.lit("010-"), _pad(k % 10000, 4), F.lit("-"), _pad(k * 7 % 10000, 4)).alias("value"),
    )
    emails_c = c.select(
        F.lit("emails").alias("kind"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("value"),
    )
    s = _read(spark, sf_dir, "supplier").filter(F.col("s_acctbal") < 0)
    ks = F.col("s_suppkey")
    phones_s = s.select(
        F.lit("phones").alias("kind"),
        F.concat(F.lit("010-"), _pad(ks % 10000, 4), F.lit("-"), _pad(ks * 7 % 10000, 4)).alias("value"),
    )
    return phones_c.unionByName(emails_c).unionByName(phones_s)


def large_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list table with four entries per order line, most of them not in any text."""
    li = _read(spark, sf_dir, "lineitem")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    serial = o * 10 + n
    entries = [
        ("phones", F.concat(F.lit("010-"), _pad(o % 10000, 4), F.lit("-"), _pad(o * 7 % 10000, 4))),
        ("phones", F.concat(F.lit("011-"), _pad(F.floor(serial / 10000) % 10000, 4), F.lit("-"), _pad(serial % 10000, 4))),
        ("emails", F.concat(F.lit("customer."), _pad(serial, 9), F.lit("@example.com"))),
        ("accounts", F.concat(_pad(o % 1000, 3), F.lit("-"), _pad(n, 2), F.lit("-"), _pad(o * 37 % 1000000, 6))),
    ]
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in entries])
    return li.select(F.explode(rows).alias("e")).select("e.kind", "e.value")
