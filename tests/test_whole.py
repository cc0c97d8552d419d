"""Registered queries take every row of their tables."""

from tidemark import catalog
from tidemark.catalog.base import entities, facts, relationships, table
from tidemark.operators import identity as ident


def test_all_names_are_compared(spark, tmp_path):
    spark.createDataFrame([(5,), (700,), (911,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r) for r in catalog.QUERIES["name_similarity"](spark, str(tmp_path)).select("p1", "p2", "match").collect()]
    assert ("c700", "c911", "exact") in got


def test_all_orders_are_parsed(spark, sf_dir):
    got = catalog.QUERIES["facet_extract_arrays"](spark, sf_dir).select("run_id").distinct()
    assert got.count() == table(spark, sf_dir, "orders").count()


def test_all_entities_are_mentions(spark, sf_dir):
    every = {r.entity_id for r in entities(spark, sf_dir).collect()}
    assert {r.mention_id for r in catalog.QUERIES["entity_resolution"](spark, sf_dir).collect()} == every
    # Every alias candidate's mention is found by its own name or address, whatever its number.
    found = catalog.QUERIES["alias_candidates"](spark, sf_dir).selectExpr("cast(substr(mention_id, 2) AS long) % 7 AS rest").distinct()
    assert found.count() == 7


def test_graph_queries_start_from_all_entities(spark, sf_dir):
    alive = entities(spark, sf_dir).where("merged_into IS NULL").select("entity_id")
    edges = relationships(spark, sf_dir).where("invalid_at IS NULL")
    out = edges.join(alive.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi").select("source_entity_id").join(entities(spark, sf_dir).selectExpr("entity_id AS source_entity_id"), "source_entity_id", "left_semi").distinct()
    got = catalog.QUERIES["graph_out"](spark, sf_dir).select("start_id").distinct()
    assert out.exceptAll(got.withColumnRenamed("start_id", "source_entity_id")).isEmpty() and got.count() > 1
    for name in ("graph_in", "graph_asof", "entity_relationships"):
        assert not catalog.QUERIES[name](spark, sf_dir).where("cast(substr(start_id, 2) AS long) % 25 != 0").isEmpty()


def test_persons_of_a_domain_are_paired_however_many(spark, sf_dir):
    emails = spark.createDataFrame([(f"p{i:02}", f"n{i}@Firm.example") for i in range(60)] + [("q1", "a@gmail.com"), ("q2", "b@gmail.com")], "person_id string, email string")
    got = ident.shared_domain(emails)
    assert got.count() == 60 * 59 // 2 and {r.domain for r in got.select("domain").distinct().collect()} == {"firm.example"}
    real = facts(spark, sf_dir).where("fact_type = 'email_personal'").selectExpr("split_part(lower(fact_value), '@', 2) AS domain").distinct()
    assert catalog.QUERIES["shared_domain"](spark, sf_dir).join(real, "domain", "left_anti").isEmpty()
