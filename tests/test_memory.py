import pytest

from tests.verification import failures, graph_rows, like
from tidemark import schemas
from tidemark.operators import graph as graph_ops
from tidemark.plans import memory


def test_a_batch_from_mentions_to_contradictions(spark):
    empty = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("entities", "aliases", "relationships", "entity_mentions", "relationship_mentions")}
    episodes = spark.createDataFrame([("e1", "2024-01-01"), ("e2", "2024-02-01")], "episode_id string, reference_time string")
    ents = spark.createDataFrame([("e1", 0, "Ann", 1), ("e1", 1, "Acme", 2), ("e1", 2, "Claude", 1), ("e2", 0, "Bob", 99)], "episode_id string, ref int, name string, entity_type_id int")
    schema = "episode_id string, source_ref int, target_ref int, target_literal string, relation_type string, fact string, source_type string, valid_at string, confidence double"
    rels = spark.createDataFrame([("e1", 0, 1, None, "WORKS_AT", "f", "mentioned", "2023", 1.0), ("e1", 0, None, "ann@x.org", "HAS_EMAIL", "f", "self_disclosed", None, 1.0), ("e1", 0, 9, None, "KNOWS", "out of range", "mentioned", None, 1.0)], schema)
    one = memory.process(empty, episodes, ents, rels, "t1")
    assert sorted(r.canonical_name for r in one["entities"].collect()) == ["Acme", "Ann", "Bob"]
    assert one["relationships"].count() == 1 and one["relationship_mentions"].count() == 2
    assert {r.entity_type_id for r in one["entities"].where("canonical_name = 'Bob'").collect()} == {0}
    # The same episodes again change nothing.
    again = memory.process(one, episodes, ents, rels, "t2")
    assert all(again[n].count() == one[n].count() for n in empty)
    # A later episode finds Ann by name and ends her old job.
    later = spark.createDataFrame([("e3", "2024-03-01")], "episode_id string, reference_time string")
    ents3 = spark.createDataFrame([("e3", 0, "ann", 1), ("e3", 1, "Bolt", 2)], "episode_id string, ref int, name string, entity_type_id int")
    rels3 = spark.createDataFrame([("e3", 0, 1, None, "WORKS_AT", "g", "mentioned", "2024", 1.0)], schema)
    two = memory.process(one, later, ents3, rels3, "t3")
    assert two["entities"].count() == 4
    assert sorted((r.valid_at, r.invalid_at) for r in two["relationships"].collect()) == [("2023", "2024"), ("2024", None)]


def _batch(spark):
    empty = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("entities", "aliases", "relationships", "entity_mentions", "relationship_mentions")}
    episodes = spark.createDataFrame([("e1", "2024-01-01")], "episode_id string, reference_time string")
    ents = spark.createDataFrame([("e1", 0, "Ann Lee", 1), ("e1", 1, "Acme Corp", 2)], "episode_id string, ref int, name string, entity_type_id int")
    schema = "episode_id string, source_ref int, target_ref int, target_literal string, relation_type string, fact string, source_type string, valid_at string, confidence double"
    rels = spark.createDataFrame([("e1", 0, 1, None, "WORKS_AT", "Ann works at Acme", "mentioned", "2023-05", 1.0), ("e1", 0, None, "ann@x.org", "HAS_EMAIL", "Ann's address", "self_disclosed", None, 1.0), ("e1", 0, None, "1990-02-03", "BORN_ON", "Ann was born", "mentioned", None, 1.0)], schema)
    return memory.process(empty, episodes, ents, rels, "t1")


def test_expectations_of_a_fixture(spark):
    graph = graph_rows(_batch(spark))
    good = {
        "entities": {"must_have": [{"name": "Ann Lee", "entity_type": "person"}, {"name_contains": "acme", "entity_type": "any"}], "must_not_have": [{"name_contains": "bob"}]},
        "relationships": {"must_have": [{"relation_type": "WORKS_AT", "source_entity_name_contains": "ann", "target": "ACME", "valid_at": "2023-05", "invalid_at": None}, {"relation_type": "BORN_ON", "target_literal_like": "1990-%-03", "valid_at": None}, {"target_literal_like": "%"}], "must_not_have": [{"relation_type": "HAS_EMAIL"}, {"relation_type": "WORKS_AT", "valid_at": None}]},
        "aliases": {"must_have": [{"alias": "ann@x.org", "alias_type": "email", "is_shared": False, "entity_name_contains": "lee"}]},
        "episode_entity_mentions": {"must_have": [{"entity_name_contains": "ann"}], "optional": [{"entity_name_contains": "nobody"}]},
        "episode_relationship_mentions": {"must_have": [{"target_literal": "ann@x.org", "relationship_id": None, "source_type": "self_disclosed"}, {"extracted_fact_contains": "WORKS at"}]},
    }
    assert failures(good, graph) == []
    bad = {"entities": {"must_have": [{"name": "ann lee"}]}, "relationships": {"must_not_have": [{"target_literal_like": "1990%"}]}, "aliases": {"must_have": [{"is_shared": True}]}, "none": {"must_have": [{"x": 1}]}}
    assert [(c, k) for c, k, _ in failures(bad, graph)] == [("entities", "must_have"), ("relationships", "must_not_have"), ("aliases", "must_have"), ("none", "must_have")]


def test_like_patterns():
    assert like("2024-01-02", "2024%") and like("2024-01-02", "%01%") and like("a.b", "a.b") and like("", "%")
    assert not like("2024", "%5") and not like("axb", "a.b") and not like("Abc", "abc")


def test_mentions_see_those_before_them(spark):
    mentions = spark.createDataFrame([("m1", "e", 0), ("m2", "e", 1), ("m3", "f", 0), ("m4", "e", 2)], "mention_id string, episode_id string, ref int")
    candidates = spark.createDataFrame([("m1", "acme", 1.0, None), ("m2", "ann1", 0.85, None), ("m2", "ann2", 0.85, None), ("m3", "ann1", 0.85, None), ("m3", "ann2", 0.85, None)], "mention_id string, entity_id string, alias_score double, embedding_score double")
    edges = spark.createDataFrame([("ann2", "acme")], "source_entity_id string, target_entity_id string")
    none = spark.createDataFrame([], "mention_id string, entity_id string")
    got = {r.mention_id: (r.decision, r.entity_id or r.top_entity_id, r.candidates_count) for r in graph_ops.resolve_in_order(mentions, candidates, edges, none).collect()}
    # Acme, resolved first, speaks for ann2, though not by the gap that a clear winner needs.
    assert got == {"m1": ("exact_alias", "acme", 1), "m2": ("ambiguous", "ann2", 2), "m3": ("ambiguous", "ann1", 2), "m4": ("created_new", None, 0)}
    swapped = mentions.replace({"e": "e"}).withColumn("ref", -mentions.ref)
    got = {r.mention_id: r.entity_id or r.top_entity_id for r in graph_ops.resolve_in_order(swapped, candidates, edges, none).collect()}
    assert got["m2"] == "ann1" and got["m1"] == "acme"


def test_candidates_are_reviewed_and_settled(spark):
    rows = [("a", "b", 0.95, True, "hard_identifier", None, 1, "pending"), ("a", "c", 0.9, True, "compound", "name_birthdate", 0, "pending"), ("b", "c", 0.85, False, "compound", "name_employer", 0, "pending"), ("c", "d", 0.99, True, "multiple_hard_identifiers", None, 2, "rejected")]
    own = spark.createDataFrame([(*r, ["f"], f"2024-0{i}", None, None, None) for i, r in enumerate(rows, 1)], "entity_a_id string, entity_b_id string, confidence double, auto_eligible boolean, reason string, compound_type string, hard_matches long, status string, matching_facts array<string>, created_at string, resolved_at string, resolved_by string, resolution_reason string")
    aliases = spark.createDataFrame([("a", "email", "x"), ("c", "email", "y")], "entity_id string, alias_type string, normalized string")
    edges = spark.createDataFrame([], schemas.TABLES["relationships"])
    seen = {(r.entity_a_id, r.entity_b_id): (r.outcome, r.auto_eligible) for r in graph_ops.review(own, aliases, edges).collect()}
    assert seen == {("a", "b"): ("merge", True), ("a", "c"): ("conflict", False), ("b", "c"): ("review", False), ("c", "d"): (None, True)}
    later = graph_ops.settle(own, own.where("entity_b_id = 'c' AND entity_a_id = 'b'"), "deferred", "me", "not sure", "2025")
    assert [(r.entity_a_id, r.entity_b_id) for r in graph_ops.pending_candidates(later).collect()] == [("a", "b"), ("a", "c")]
    assert later.where("resolved_by = 'me' AND resolution_reason = 'not sure' AND resolved_at = '2025'").count() == 1
    with pytest.raises(ValueError):
        graph_ops.settle(own, own, "gone", "me", None, "2025")
    merged = own.where("entity_b_id != 'd' AND entity_a_id != 'b'")
    events = graph_ops.merge_events(merged, graph_ops.merge_mapping(merged), "auto", "2026")
    assert sorted((r.source_entity_id, r.target_entity_id) for r in graph_ops.merge_history(events, "a").collect()) == [("b", "a"), ("c", "a")]
    assert graph_ops.merge_history(events, "z").count() == 0
