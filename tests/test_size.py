"""What grows with the tables: nothing that the planner takes for small passes through the driver."""

import re

from granary.operators import graph, store
from granary.plans import catalogue

AT = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_archives_and_contents_are_not_broadcast(spark):
    for name in ("archive_split", "stream_codec"):
        plan = plan_of(catalogue.queries()[name](spark, AT))
        assert "SortMergeJoin" in plan and not re.search("Broadcast", plan)
    chunks = spark.createDataFrame([("s", 0, b"a", None), ("s", 1, None, "o")], "stream_id string, seq long, inline binary, object_id string")
    whole = store.reassembled(chunks, spark.createDataFrame([("o", b"b")], "object_id string, data binary"))
    assert not re.search("Broadcast", plan_of(whole)) and [bytes(r.data) for r in whole.collect()] == [b"ab"]


def test_manifests_and_referrers_are_not_broadcast(spark):
    assert not re.search("Broadcast", plan_of(catalogue.queries()["referrer_edges"](spark, AT)))


def test_a_walk_reads_links_made_once(spark, monkeypatch):
    read = []
    walk = graph.closure
    monkeypatch.setattr(graph, "closure", lambda edges, *a: read.append(plan_of(edges)) or walk(edges, *a))
    plan = plan_of(catalogue.queries()["gc_plan"](spark, AT))
    assert "sha2" not in plan and len(read) == 1 and "Scan ExistingRDD" in read[0] and "Join" not in read[0]


def test_streams_are_not_pickled(spark):
    assert "BatchEvalPython" not in plan_of(catalogue.queries()["stream_problems"](spark, AT))
