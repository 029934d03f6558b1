"""Allow-lists given as tables: filters made exact for the corpus, whatever their error rate."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from piisift.config import ALLOWLIST_KINDS, DEFAULT_ALLOWLIST, DetectorConfig
from piisift.functions import bloom
from piisift.operators import allowlist
from piisift.operators.detect import detect, explode_matches, with_candidates
from piisift.operators.guard import guard, scrub
from piisift.operators.longform import filter_allowlisted
from piisift.operators.reports import allowlist_impact, allowlist_impact_table
from piisift.plans import catalog, inputs


def as_lists(table):
    out = {k: [] for k in ALLOWLIST_KINDS}
    for r in table.collect():
        if r.kind in out and r.value is not None:
            out[r.kind].append(r.value)
    return out


def rows(df):
    return sorted((r.doc_id, tuple((m.ptype, m.span_start, m.span_end) for m in r.matches)) for r in df.collect())


@pytest.fixture(params=[None, (1 << 15, 1), (1 << 15, 3)], ids=["production", "crowded", "small"])
def sized(request, monkeypatch):
    """Production filters, and such as let much through, so that several levels are needed."""
    if request.param:
        monkeypatch.setattr(bloom, "FILTER_BITS", request.param[0])
        monkeypatch.setattr(bloom, "HASHES", request.param[1])
    return request.param


def test_membership_is_exact(spark, sized):
    listed = [("phones", f"010-{i}") for i in range(0, 60_000, 2)] + [("emails", f"a{i}@b.co") for i in range(40)] + [("other", "010-1"), ("phones", None), (None, "010-3")]
    allow = spark.createDataFrame(listed, "kind string, value string")
    keys = [("PHONE", f"010-{i}") for i in range(20_000)] + [("EMAIL", f"a{i}@b.co") for i in range(80)] + [("ACCOUNT", "010-2"), ("PHONE", None), ("PHONE", "")] * 3
    df = spark.createDataFrame(keys, "ptype string, value string").repartition(4)
    test = allowlist.membership(df, allow)
    got = {(r.ptype, r.value): r.hit for r in df.select("ptype", "value", test(lambda t: t(F.col("ptype"), F.col("value"))).alias("hit")).collect()}
    want = {(ALLOWLIST_KINDS[k], v) for k, v in listed if k in ALLOWLIST_KINDS and v is not None}
    assert got == {k: k in want for k in keys}
    none = allowlist.membership(df, allow.limit(0))
    assert df.where(none(lambda t: t(F.col("ptype"), F.col("value")))).count() == 0


def some_texts(spark):
    return inputs.customer_records(spark, SF_SMALL).unionByName(inputs.supplier_contacts(spark, SF_SMALL)).coalesce(2)


def test_detect_with_a_table_equals_the_same_list(spark, sized):
    texts = some_texts(spark)
    allow = catalog._large_allow(spark, SF_SMALL) if sized is None else catalog._extended_allow(spark, SF_SMALL)
    lists = as_lists(allow)
    expected = rows(detect(texts, config=DetectorConfig(allowlist={k: DEFAULT_ALLOWLIST[k] + v for k, v in lists.items()})))
    assert rows(detect(texts, allowlist_table=allow)) == expected != rows(detect(texts))


def test_no_text_is_exchanged(spark):
    allow = catalog._extended_allow(spark, SF_SMALL)
    plan = scrub(some_texts(spark), allowlist_table=allow)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert guard(some_texts(spark), allowlist_table=allow).agg(F.max("pii_score")).first()[0] > 0


def test_impact_of_a_table_equals_the_same_list(spark, sized):
    texts, allow = some_texts(spark), catalog._extended_allow(spark, SF_SMALL)
    after = DetectorConfig(allowlist=as_lists(allow))
    table = allowlist_impact_table(texts, allow)
    cols = sorted(table.columns)
    a = sorted(tuple(r[c] for c in cols) for r in table.collect())
    b = sorted(tuple(r[c] for c in cols) for r in allowlist_impact(texts, DetectorConfig(), after).collect())
    assert a == b and any(r[cols.index("delta")] != 0 for r in a)


def test_streams_take_lists_only(spark):
    stream = spark.readStream.schema("doc_id string, text string").parquet(SF_SMALL)
    with pytest.raises(ValueError):
        detect(stream, allowlist_table=catalog._extended_allow(spark, SF_SMALL))


def test_antijoin_of_match_rows(spark):
    c = explode_matches(with_candidates(some_texts(spark), allowlist=False), ["doc_id"], "_cands")
    allow = catalog._extended_allow(spark, SF_SMALL)
    listed = {(ALLOWLIST_KINDS[k], v) for k, vs in as_lists(allow).items() for v in vs}
    kept = sorted((r.doc_id, r.ptype, r.value, r.span_start) for r in filter_allowlisted(c, allow).collect())
    assert kept == sorted((r.doc_id, r.ptype, r.value, r.span_start) for r in c.collect() if (r.ptype, r.value) not in listed)


def test_entries_in_no_text_do_not_crowd_a_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "FILTER_BITS", 1 << 15)
    made = []
    monkeypatch.setattr(allowlist, "bloom_filter", lambda *a, **kw: made.append(bloom.bloom_filter(*a, **kw)) or made[-1])
    allow = spark.range(200_000).select(F.lit("phones").alias("kind"), F.concat(F.lit("011-"), F.col("id").cast("string")).alias("value"))
    df = spark.range(20_000).select(F.lit("PHONE").alias("ptype"), F.concat(F.lit("011-"), (F.col("id") * 20).cast("string")).alias("value"))
    test = allowlist.membership(df, allow)
    assert df.where(test(lambda t: t(F.col("ptype"), F.col("value")))).count() == 10_000
    assert len(made) <= 4 and len(made[0]) >= 2 * 10_000
