"""Pairs come from classes: all of them, each once, and none is moved to be grouped."""

import itertools
import re

import duckdb
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import graph
from tidemark.operators import identity as ident
from tidemark.plans.classes import crossed, expanded


def moves(df, *columns):
    """Whether the plan deals rows out by any of `columns`."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(re.search(rf"\b{c}#", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) for c in columns)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_related_classes_give_each_pair_once_whatever_the_block(spark):
    members = spark.createDataFrame([("a", f"x{i:02}") for i in range(23)] + [("b", f"w{i:02}") for i in range(9)] + [("c", "z")], "class string, id string")
    related = spark.createDataFrame([("a", "a", 1), ("b", "a", 2), ("c", "c", 3)], "c1 string, c2 string, n int")
    a, b = [f"x{i:02}" for i in range(23)], [f"w{i:02}" for i in range(9)]
    wanted = sorted([(p, q, 1) for p, q in itertools.combinations(a, 2)] + [(q, p, 2) for p in a for q in b])
    for block in (1, 4, 1000):
        assert rows(expanded(related, members, "id", block)) == wanted
    told = members.selectExpr("class", "id", "id || '!' AS t")
    assert rows(expanded(related, told, "id", 4, ("t",)).selectExpr("p1", "p2", "n", "t1 = p1 || '!' AND t2 = p2 || '!'")) == [(*w, True) for w in wanted]


def test_similar_names_are_not_grouped_by_pairs(spark):
    people = [("p1", "Anna Bell", None), ("p2", "anna  bell", "Bell"), ("p3", "Anna Bell Jr", "anna bel"), ("p4", "Bell", None), ("p5", "Annabella", None), ("p6", "anna belle", "anna bel"), ("p7", "anna belle", "anna bel")]
    got = ident.name_similarity(spark.createDataFrame(people, "person_id string, canonical_name string, display_name string"))
    form = lambda n: re.sub(r"\s+", " ", re.sub(" (jr|sr)$", "", n.lower().strip())).strip()
    names = {p: {form(x) for x in n if x} for p, *n in people}
    wanted = []
    for p, q in itertools.combinations(names, 2):
        near = any(min(len(x), len(y)) >= 4 and (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) > 0.5 for x in names[p] for y in names[q])
        if names[p] & names[q]:
            wanted.append((p, q, "exact", 0.8))
        elif near:
            wanted.append((p, q, "substring", 0.6))
    assert rows(got.select("p1", "p2", "match", "confidence")) == wanted
    assert not moves(got, "p1", "p2")


def test_persons_of_a_domain_are_not_grouped_by_pairs(spark):
    emails = [("a", "x@one.example"), ("a", "x@Two.example"), ("b", "y@one.example"), ("b", "z@two.example"), ("c", "c@two.example"), ("d", "d@two.example"), ("e", "e@gmail.com"), ("f", "f@gmail.com"), ("g", "odd"), (None, "n@two.example")]
    got = ident.shared_domain(spark.createDataFrame(emails, "person_id string, email string"))
    both = [(p, q, "two.example", 0.5) for p, q in itertools.combinations("abcd", 2)]
    assert rows(got.select("p1", "p2", "domain", "confidence")) == [("a", "b", "one.example", 0.5), *both[1:]]
    assert not moves(got, "p1", "p2")


def _graph(spark):
    n = 40
    ents = spark.createDataFrame([(f"e{i:02}", f"n{i}", None if i % 13 else "e01") for i in range(n)], "entity_id string, canonical_name string, merged_into string")
    al = [(f"e{i:02}", f"m{i % 3}", "email", f"m{i % 3}", i == 5) for i in range(n) if i % 4] + [(f"e{i:02}", f"p{i % 7}", "phone", f"p{i % 7}", None) for i in range(n) if i % 3] + [(f"e{i:02}", f"q{i % 5}", "phone", f"q{i % 5}", False) for i in range(n) if i % 2] + [(f"e{i:02}", "x", "name", f"x{i % 2}", False) for i in range(n)]
    rel = [(f"r{i}-{j}", f"e{i:02}", None, f"D{(i * j) % 4}", "BORN_ON", None, f"t{j}") for i in range(n) for j in (1, 3)] + [(f"w{i}", f"e{i:02}", f"s{i % 5}", None, "WORKS_AT", "gone" if i == 7 else None, "t") for i in range(n)]
    return ents, spark.createDataFrame(al, "entity_id string, alias string, alias_type string, normalized string, is_shared boolean"), spark.createDataFrame(rel, "relationship_id string, source_entity_id string, target_entity_id string, target_literal string, relation_type string, invalid_at string, created_at string")


def _brute(ents, al, rel):
    alive = sorted(e.entity_id for e in ents.collect() if e.merged_into is None)
    al, rel = al.collect(), rel.collect()
    keys = {e: set() for e in alive}
    for e in alive:
        keys[e] |= {(0, f"{a.alias_type}:{a.normalized}") for a in al if a.entity_id == e and a.alias_type != "name" and not a.is_shared}
        for kind, label, relation in ((1, "name_birthdate", "BORN_ON"), (2, "name_employer", "WORKS_AT")):
            keys[e] |= {(kind, f"{label}:{a.normalized}/{r.target_entity_id or r.target_literal.lower()}") for a in al if a.entity_id == e and a.alias_type == "name" for r in rel if r.source_entity_id == e and r.relation_type == relation and r.invalid_at is None}
    own = {e: {k: {a.normalized for a in al if a.entity_id == e and a.alias_type == k} for k in ("email", "phone")} for e in alive}
    for e in alive:
        born = [(r.created_at, r.relationship_id, r.target_literal) for r in rel if r.source_entity_id == e and r.relation_type == "BORN_ON"]
        own[e]["birthdate"] = {max(born)[2]} if born else set()
    out = []
    for a, b in itertools.combinations(alive, 2):
        both = keys[a] & keys[b]
        if both:
            kind = min(both)[0]
            hard = sum(k == 0 for k, _ in both)
            label = ((0.99, "multiple_hard_identifiers", None) if hard > 1 else (0.95, "hard_identifier", None)) if hard else ((0.90, "compound", "name_birthdate"), (0.85, "compound", "name_employer"))[kind - 1]
            conflicts = [k for k in ("birthdate", "email", "phone") if own[a][k] and own[b][k] and not own[a][k] & own[b][k]]
            out.append((a, b, *label, sorted(f for k, f in both if k == kind), hard, conflicts))
    return out


def test_entities_meet_once_under_their_first_shared_key(spark):
    own = _graph(spark)
    wanted = _brute(*own)
    got = graph.entity_collisions(*own, conflicts=True)
    assert sorted(map(tuple, got.select("entity_a_id", "entity_b_id", "confidence", "reason", "compound_type", "matching_facts", "hard_matches", "conflicts").collect()), key=lambda r: r[:2]) == wanted
    assert not moves(got, "entity_a_id", "entity_b_id", "p1", "p2")
    plain = graph.entity_collisions(*own)
    assert rows(graph.merge_conflicts(plain, own[1], own[2]).select("entity_a_id", "entity_b_id", "conflicts")) == [(*w[:2], w[-1]) for w in wanted]
    assert {r.entity_id for r in graph.colliding(*own).collect()} == {e for w in wanted for e in w[:2]}


def test_collisions_of_one_entity_are_found_from_its_own_keys(spark):
    own = _graph(spark)
    every = _brute(*own)
    for one in ("e01", "e30", "nobody"):
        got = graph.collisions_of(*own, one)
        assert rows(got.select("entity_a_id", "entity_b_id", "confidence", "matching_facts")) == [(*w[:3], w[5]) for w in every if one in w[:2]]
        assert not moves(got, "entity_a_id", "entity_b_id", "p1", "p2")


def test_candidates_are_settled_by_a_condition_without_a_join(spark):
    own = spark.createDataFrame([("a", "b", "pending", None, None, None), ("a", "c", "pending", None, None, None)], "entity_a_id string, entity_b_id string, status string, resolved_at string, resolved_by string, resolution_reason string")
    got = graph.settle(own, own["entity_b_id"] == "c", "deferred", "me", "later", "t")
    assert rows(got.select("entity_b_id", "status", "resolved_at")) == [("b", "pending", None), ("c", "deferred", "t")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_persons_of_an_event_are_added_up_where_they_meet(spark):
    met = {(f"e{e}", f"p{p:03}") for e in range(12) for p in range(40) if (p * (e + 3)) % 11 < e} | {("full", f"p{p:03}") for p in range(40)}
    wanted = sorted((p, q, n) for p, q in itertools.combinations(sorted({p for _, p in met}), 2) if (n := sum((e, p) in met and (e, q) in met for e, _ in {(e, 0) for e, _ in met})))
    people = spark.createDataFrame([(e, f"c{p}") for e, p in sorted(met)] + [("e1", None), (None, "cp001")], "event_id string, contact_id string")
    links = spark.createDataFrame([(f"cp{p:03}", f"p{p:03}") for p in range(40)] + [("cp001", "p001")], "contact_id string, person_id string")
    for block, most in ((1000, 1000), (7, 1000), (7, 5)):
        got = ident.co_occurrence(people, links, block, most)
        assert rows(got.select("p1", "p2", "n")) == wanted
    assert not moves(ident.co_occurrence(people, links), "p1", "p2")


def test_compound_matches_are_not_grouped_by_pairs(spark):
    facts = [(f"p{i:02}", "full_legal_name", f"N{n}") for i in range(24) for n in {i % 2, i % 3}] + [(f"p{i:02}", "birthdate", f"B{i % 4}") for i in range(24) if i % 5] + [(f"p{i:02}", t, "X") for i in range(24) for t in ("employer_current", "location_current") if i % 7]
    own = {}
    for p, t, v in facts:
        own.setdefault(p, {}).setdefault(t, set()).add(v)
    wanted = []
    for p, q in itertools.combinations(sorted(own), 2):
        both = {t: own[p].get(t, set()) & own[q].get(t, set()) for t in ("full_legal_name", "birthdate", "employer_current", "location_current")}
        wanted += [(p, q, "name_birthdate", 0.90)] * bool(both["full_legal_name"] and both["birthdate"]) + [(p, q, "name_employer_city", 0.85)] * bool(both["full_legal_name"] and both["employer_current"] and both["location_current"])
    got = ident.compound_matches(spark.createDataFrame(facts, "person_id string, fact_type string, fact_value string"))
    assert rows(got.select("p1", "p2", "compound_type", "confidence")) == sorted(wanted)
    assert not moves(got, "p1", "p2")


def test_candidates_found_again_are_upserted_without_a_join(spark):
    state = spark.createDataFrame([("a", "b", 0.9, None, "pending"), ("a", "c", 0.99, True, "pending"), ("b", "c", 0.9, False, "rejected"), ("b", "d", 0.9, False, "pending")], "entity_a_id string, entity_b_id string, confidence double, auto_eligible boolean, status string")
    again = F.when(F.col("entity_b_id") != "d", F.lit(0.97))
    got = graph.upsert_candidates(state, again)
    by_rows = graph.upsert_candidates(state, state.where("entity_b_id != 'd'").withColumn("confidence", F.lit(0.97)).drop("auto_eligible", "status"))
    assert rows(got) == rows(by_rows) and not moves(got, "entity_a_id", "entity_b_id")


def test_mentions_meet_candidates_of_their_name_in_blocks(spark):
    mentions = spark.createDataFrame([*((f"m{i}", f"n{i % 2}") for i in range(9)), ("m0", "N1 "), ("m9", None), ("m8", "x")], "mention_id string, name string")
    ents = spark.createDataFrame([(f"e{i}", None if i else "e1") for i in range(12)], "entity_id string, merged_into string")
    al = spark.createDataFrame([(f"e{i}", "N1 " if i % 4 == 0 else "a", "email" if i % 2 else "name", f"n{i % 3}", i == 7) for i in range(12)], "entity_id string, alias string, alias_type string, normalized string, is_shared boolean")
    got = graph.alias_candidates(mentions, al, ents)
    whole = graph._class_candidates(mentions, al, ents)
    assert rows(got.select(*whole.columns)) == rows(whole) and len(rows(whole)) > 20
    assert not moves(got, "mention_id")
    left, right = mentions.selectExpr("name AS class", "mention_id AS l").where("class LIKE 'n%'"), spark.range(30).selectExpr("'n' || id % 3 AS class", "id AS r")
    assert rows(crossed(left, right, 4)) == rows(left.join(right, "class").select("l", "r"))


def test_entities_are_resolved_by_name_as_by_mention(spark):
    mentions = spark.createDataFrame([(f"m{i}", f"n{i % 4}") for i in range(12)], "mention_id string, name string")
    scores = [("n0", "a", 1.0, 0.3), ("n0", "b", 1.0, 0.3), ("n1", "a", 0.85, None), ("n2", "c", 0.95, 0.0), ("n2", "d", 0.5, 0.0), ("n2", "e", 0.7, 0.3)]
    by_name = spark.createDataFrame([(n, e, a, None, c) for n, e, a, c in scores], "name string, entity_id string, alias_score double, embedding_score double, context_score double")
    assert rows(graph.resolve(mentions, by_name, by="name")) == rows(graph.resolve(mentions, by_name.join(mentions, "name").drop("name")))
    assert not any("Window" in line for line in graph.resolve(mentions, by_name, by="name")._jdf.queryExecution().executedPlan().toString().splitlines())


def test_pairs_of_two_blocks_are_made_as_they_are_taken(spark):
    members = spark.range(3000).selectExpr("'a' AS class", "'x' || id AS id")
    related = spark.createDataFrame([("a", "a")], "c1 string, c2 string")
    got = expanded(related, members, "id", 2000)
    assert got.count() == 3000 * 2999 // 2
    # From the pairs down: two of pieces, a step of its own, two of blocks. In one step all pairs of two blocks would be held.
    steps = [n for n in re.findall(r"\b(Generate|Coalesce|Exchange)\b", got._jdf.queryExecution().executedPlan().toString())]
    assert steps[:5] == ["Generate", "Generate", "Coalesce", "Generate", "Generate"]


def test_collisions_of_tables_that_are_not_broadcast(spark, tmp_path):
    spark.range(3000).selectExpr("id AS c_custkey", "'n' || id AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(200).selectExpr("id AS s_suppkey", "'n' || id AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(9000).selectExpr("id AS o_orderkey", "id * 7 % 3000 AS o_custkey", "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus", "timestamp'1996-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 900 AS int)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    names = ("entity_collisions", "auto_merge_rule")
    pairs = {}
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "24"}
    before = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        for name in names:
            pairs[name] = rows(catalog.QUERIES[name](spark, str(tmp_path)).select("entity_a_id", "entity_b_id"))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    db = duckdb.connect()
    for t in ("customer", "supplier", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = sorted(db.execute(f"SELECT entity_a_id, entity_b_id FROM ({catalog.ORACLE_SQL['entity_collisions']})").fetchall())
    assert len(wanted) > 5000 and all(p == wanted for p in pairs.values())
