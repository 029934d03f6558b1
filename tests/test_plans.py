"""Physical-plan properties: each regex runs once per row; scans are pruned."""

from conftest import SF_SMALL

import __spark_entry__ as entry_mod
from piisift.plans import inputs
from tools.plan_report import facts


def test_detection_is_map_only_and_pruned(spark):
    from piisift.operators.guard import scrub

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = scrub(docs)._jdf.queryExecution().executedPlan().toString()
    f = facts(plan)
    assert f["exchanges"] == 0 and f["windows"] == 0
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scans(spark):
    plan = entry_mod.queries()["whitelist_filter"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "LessThan(s_acctbal,0.0)" in plan
    turns = inputs.conversation_turns(spark, SF_SMALL, role="assistant")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in turns


def test_responses_for_every_text(spark):
    queries = entry_mod.queries()
    kinds = {r["doc_id"].split("-")[0] for r in inputs.all_texts(spark, SF_SMALL).select("doc_id").collect()}
    assert len(kinds) == 7
    for name in ("guard_response", "scrub_response"):
        assert {r["doc_id"].split("-")[0] for r in queries[name](spark, SF_SMALL).select("doc_id").collect()} == kinds


def test_texts_are_dealt_out_without_a_setting(spark):
    given = spark.conf.get("spark.piisift.inputPartitions")
    spark.conf.unset("spark.piisift.inputPartitions")
    try:
        texts = inputs.all_texts(spark, SF_SMALL)
        assert texts.rdd.getNumPartitions() == inputs.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.piisift.inputPartitions", given)
