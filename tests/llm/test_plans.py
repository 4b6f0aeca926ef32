"""What runs: native operators without Python, only the columns that are needed, whole tables."""

import re

import pytest

from granary.llm import queries, spotsigs

AT = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_spotsigs", "spotsigs_links"])
def test_native_operators_run_no_python(spark, name):
    for at in (AT, AT.replace("0.001", "0.01")):
        plan = plan_of(queries.queries()[name](spark, at))
        assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


def test_scans_read_what_they_need(spark):
    plan = plan_of(queries.op2_url_filter(spark, AT))
    assert "html" not in plan
    plan = plan_of(queries.op9_quality_rules(spark, AT))
    assert "lang" not in plan and "Exchange" not in plan


def test_no_query_limits_its_table(spark):
    for name in ("op1_chat_formatting", "op2_url_filter", "op4_html_extraction", "op9_quality_rules"):
        assert not re.search("Limit|Sample", plan_of(queries.queries()[name](spark, AT)))


def test_signatures_are_shuffled_once(spark, monkeypatch):
    plans = {}
    write = spotsigs.written
    monkeypatch.setattr(spotsigs, "written", lambda df, name, *a: plans.setdefault(name, plan_of(df)) and write(df, name, *a))
    queries.spotsigs_links(spark, AT)
    ranked = plans["spot-prefixes"]
    assert len(re.findall(r"Exchange hashpartitioning\(s#", ranked)) == 1 and "Join" not in ranked
    assert "signatures" not in plans["spot-candidates"]
