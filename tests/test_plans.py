"""What the plans must look like to hold at scale."""

import re

import pytest

from murmur.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_python_workers(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEvalPython"):
        assert node not in text


@pytest.mark.parametrize("name", ["dedup_by_id", "dedup_by_content", "clean_feedback", "summary_by_location"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    assert "row_number(), 1, Partial" in plan(spark, name) or "row_number(), 3, Partial" in plan(spark, name)


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan(spark, "priority_problems")
    assert "ReadSchema: struct<source:string>" not in plan(spark, "classify_sentiment")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, "classify_sentiment")


def test_date_filter_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan(spark, "filter_date_range")


def test_headline_is_one_scan(spark):
    assert plan(spark, "headline_metrics").count("FileScan") == 1
    assert plan(spark, "priority_problems").count("FileScan") == 1
    assert plan(spark, "dataset_summary").count("FileScan") == 1


def test_answers_take_few_scans_of_the_records(spark, monkeypatch):
    """Counted over everything that runs while the answers are built, and the result itself."""
    from murmur.operators import questions
    from murmur.plans import bindings

    seen = []

    def note(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for name in ("cut_lineage", "broadcast_if_small"):
        original = getattr(questions, name)
        monkeypatch.setattr(questions, name, lambda df, original=original: original(note(df)))
    note(questions.answer_questions(bindings.questions(spark, SF), bindings.events_feedback(spark, SF)))
    scans = [len(re.findall(r"FileScan parquet \[[^\]]*\b(?:event_id|event_type|user_id|ts)#", p)) for p in seen]
    assert 0 < sum(scans) <= 6, scans
