"""What the physical plans must and must not hold."""

import pytest

from claimweave.plans import queries

FOLDER = "/root/testdata/sf0.001"
#: These join tables of one row each.
ONE_ROW = {"review_backlog", "decision_guard", "graph_cycle_check", "reading_verdicts", "import_report"}
#: These read files or pages, name things beyond ASCII, or call a service.
PYTHON = {"page_items", "poll_rows", "result_rows", "federal_contest_keys", "division_rows", "normalized_names", "geocode_results", "cited_sources"}


def plan(spark, name):
    return queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - PYTHON))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"))
    assert name in ONE_ROW or "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "review_pending_topk")
    assert "WindowGroupLimit" in plan(spark, "claims_about_subject")


def test_scans_read_what_they_need(spark):
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan(spark, "donation_rollup")
    assert "StringStartsWith" not in plan(spark, "donation_rollup")
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)" in plan(spark, "claims_in_subject_set")


def test_latest_verdict_is_one_aggregation(spark):
    assert "Join" not in plan(spark, "poll_verdicts_latest")
