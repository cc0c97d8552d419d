"""Mentions resolved in order from few candidates, and suggestions of persons with any number."""

import random

from tidemark import catalog
from tidemark.operators import graph


def test_mentions_in_order_need_only_the_candidates_that_can_win(spark):
    draw = random.Random(5)
    entities = [f"e{i:02}" for i in range(40)]
    score = {(f"n{k}", e): draw.choice([0.5, 0.6, 0.85, 0.85, 0.95, 1.0]) for k in range(8) for e in draw.sample(entities, draw.choice([1, 2, 6, 12]))}
    score["n0", "e00"] = 1.0
    mentions = [(f"m{ep}-{r}", ep, r, f"n{draw.randrange(9)}") for ep in range(40) for r in range(5)]
    edges = {tuple(draw.sample(entities, 2)) for _ in range(60)}
    recent = {(m[0], e) for m in mentions for n, e in score if n == m[3] and draw.random() < 0.05}
    near = edges | {(b, a) for a, b in edges}
    wanted, resolved = {}, {}
    for m, ep, _, name in sorted(mentions, key=lambda m: (m[1], m[2], m[0])):
        own = sorted((-(s * 0.5 + 0.2 * (0.3 * any((e, x) in near for x in resolved.get(ep, ())) + 0.2 * ((m, e) in recent))), e, s) for (n, e), s in score.items() if n == name)
        if not own:
            wanted[m] = ("created_new", None, 0)
            continue
        total, best, alias = -own[0][0], own[0][1], own[0][2]
        clear = len(own) == 1 or total + own[1][0] >= graph.CLEAR_GAP
        decision = "high_confidence" if total >= graph.HIGH_CONFIDENCE else "exact_alias" if alias >= graph.ALIAS_EXACT else "clear_winner" if clear and total >= graph.LEAST_MATCH else "ambiguous"
        if decision != "ambiguous":
            resolved.setdefault(ep, set()).add(best)
        wanted[m] = (decision, best, len(own))
    said = spark.createDataFrame(mentions, "mention_id string, episode_id long, ref long, name string")
    found = spark.createDataFrame([(*k, s, None) for k, s in score.items()], "name string, entity_id string, alias_score double, embedding_score double")
    rel = spark.createDataFrame(sorted(edges), "source_entity_id string, target_entity_id string")
    lately = spark.createDataFrame(sorted(recent), "mention_id string, entity_id string")
    each = said.join(found, "name").select("mention_id", "entity_id", "alias_score", "embedding_score")
    assert {w[0] for w in wanted.values()} == {"created_new", "exact_alias", "clear_winner", "ambiguous"}
    for got in (graph.resolve_in_order(said, found, rel, lately, by="name"), graph.resolve_in_order(said, each, rel, lately)):
        assert {r.mention_id: (r.decision, r.entity_id or r.top_entity_id, r.candidates_count) for r in got.collect()} == wanted


def test_persons_with_large_keys_are_alive(spark, tmp_path):
    spark.createDataFrame([(1, 400_000), (2, 400_001), (7, 400_000), (5, 400_002)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["expired_suggestions"](spark, str(tmp_path))
    assert {r.merge_id: r.status for r in got.collect()} == {1: "pending", 2: "expired", 7: "expired", 5: "rejected"}


def _rows_moved(spark):
    sc = spark.sparkContext
    none = spark._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_mentions_in_order_are_moved_a_few_times_each(spark):
    mentions = spark.range(9000).selectExpr("'m' || id AS mention_id", "id div 3 AS episode_id", "id % 3 AS ref", "'n' || (id * 7 % 40) AS name")
    found = spark.range(400).selectExpr("'n' || id % 40 AS name", "'e' || id AS entity_id", "1.0D AS alias_score", "cast(null as double) AS embedding_score")
    edges = spark.range(40).selectExpr("'e' || id AS source_entity_id", "'e' || id * 9 AS target_entity_id")
    before = _rows_moved(spark)
    got = graph.resolve_in_order(mentions, found, edges, spark.createDataFrame([], "mention_id string, entity_id string"), by="name")
    assert got.where("decision = 'exact_alias'").count() == 9000
    # Each to its episode, with each earlier key to what edges lead to, and to the walk.
    assert _rows_moved(spark) - before < 3 * 9000


def test_of_a_hubs_many_neighbours_the_best_are_moved(spark):
    mentions = spark.range(900).selectExpr("'m' || id AS mention_id", "id div 3 AS episode_id", "id % 3 AS ref", "'n' || id % 3 AS name")
    own = [("n0", "a"), ("n1", "b0"), ("n1", "b1"), ("n1", "hub"), *(("n2", f"c{i:03}") for i in range(500))]
    found = spark.createDataFrame([(*c, 0.85, None) for c in own], "name string, entity_id string, alias_score double, embedding_score double")
    edges = spark.createDataFrame([("a", "hub"), *(("hub", f"c{i:03}") for i in range(7, 500))], "source_entity_id string, target_entity_id string")
    recent = spark.createDataFrame([("m2", "c400")], "mention_id string, entity_id string")
    before = _rows_moved(spark)
    got = {r.mention_id: (r.entity_id or r.top_entity_id, r.candidates_count) for r in graph.resolve_in_order(mentions, found, edges, recent, by="name").collect()}
    # By an edge the hub wins against those before it, and by another what it leads to.
    assert got["m0"] == ("a", 1) and got["m1"] == ("hub", 3)
    assert _rows_moved(spark) - before < 10_000
