"""Rows that have nothing to meet don't all come to one task."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encode, facets
from tidemark.operators import identity as ident


@pytest.fixture
def plain(spark):
    """Joins by shuffles, whose partitions stay as they are."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def largest(df):
    """The rows of the task that has most."""
    # All columns are asked for, else a join might be left out.
    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns)).alias("h")).agg(F.max("n"), F.max("h")).first()[0]


def test_events_that_reply_to_nothing(plain):
    events = plain.range(0, 2000, 1, 4).selectExpr("id AS event_id", "'c' || id AS content", "CASE WHEN id % 100 = 1 THEN id - 1 WHEN id % 100 = 2 THEN -1 END AS reply_to")
    out = encode.with_originals(events, events)
    assert largest(out) < 1000
    assert {(r.event_id, r.original) for r in out.collect()} == {(i, f"c{i - 1}" if i % 100 == 1 else None) for i in range(2000)}


def test_outputs_without_an_identifier(plain):
    runs = plain.range(0, 1000, 1, 4).selectExpr("id AS run_id", "id AS episode_id", "'c' AS channel", """concat('{"extraction_metadata":{', CASE WHEN id % 100 = 0 THEN concat('"primary_contact_identifier":"A', id, '@b.c"') ELSE '' END, '},"facts":[{"subject_kind":"primary_contact","category":"c","fact_type":"x","value":"y"}]}') AS output_text""")
    there = runs.selectExpr("episode_id", "'me' AS person_id", "'M' AS canonical_name", "cast(null as string) AS display_name", "true AS is_me")
    ids = plain.createDataFrame([("a100@b.c", "p2"), ("a100@b.c", "p1"), ("a300@b.c", "p3"), (None, "p4")], "normalized string, person_id string")
    seen = []
    kind = type(runs)
    join = kind.join
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(kind, "join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
        out = facets.process_extractions(runs, there, ids)
    assert largest(seen[0]) < 500  # outputs with the identifiers' persons
    assert {(r.person_id, r.source_episode_id) for r in out["facts"].collect()} == {("p1", 100), ("p3", 300)}


def test_facts_move_without_being_ordered(plain):
    facts_ = plain.createDataFrame([("a", "c", "t", "v", 0.5), ("b", "c", "t", "v", 0.9), ("d", "c", "t", "v", 0.1)], "person_id string, category string, fact_type string, fact_value string, confidence double")
    links = plain.createDataFrame([], "person_id string, contact_id string, confidence double, first_seen_at long, last_seen_at long")
    out = ident.merge_persons(plain.createDataFrame([], "person_id string, canonical_name string"), links, facts_, plain.createDataFrame([("b", "a"), ("d", "d")], "person_id string, canonical_id string"))[2]
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("a", "c", "t", "v", 0.9), ("d", "c", "t", "v", 0.1)]


def test_facets_of_a_session_event(plain):
    rows = ['{"relevantFiles":["f","",null,"f"],"toolFormerData":{"name":"t","toolCallId":"7"},"isAgentic":true,"capabilitiesRan":{"a":[1,2],"b":[],"":[1]},"capabilityStatuses":{"b":[1],"a":[1],"c":null}}', "{}", "no json", None, '{"isAgentic":true}']
    events = plain.createDataFrame([*enumerate(rows)], "event_id long, metadata_json string")
    out = facets.session_facets(events, done=plain.createDataFrame([(4,), (4,), (None,)], "event_id long"))
    want = [(0, "capability", "a", '{"count":2}'), (0, "capability", "b", '{"count":1}'), (0, "file_reference", "f", None), (0, "file_reference", "f", None), (0, "mode", "agentic", None), (0, "tool_invocation", "t", '{"call_id":"7","status":""}')]
    assert sorted(map(tuple, out.collect()), key=str) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Union" not in plan
