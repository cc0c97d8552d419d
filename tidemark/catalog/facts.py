"""Identity resolution over facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import FACTS, facts, query
from tidemark.operators import identity as ident


def _list(types) -> str:
    return ", ".join(f"'{t}'" for t in types)


NORMAL = f"CASE WHEN fact_type IN ({_list(ident.PHONES)}) THEN regexp_replace(lower(trim(fact_value)), '[- ()+.]', '', 'g') WHEN fact_type IN ({_list(ident.SOCIAL)}) THEN trim(replace(lower(trim(fact_value)), '@', '')) ELSE lower(trim(fact_value)) END"


def _groups(name: str, types, value: str = "fact_value") -> str:
    each = f"{name}_each AS (SELECT fact_type, {value} AS fact_value, person_id, SUM(confidence) AS s, COUNT(confidence) AS n FROM facts WHERE fact_type IN ({_list(types)}) GROUP BY fact_type, {value}, person_id)"
    return f"{each}, {name} AS (SELECT fact_type, fact_value, COUNT(*) AS person_count, SUM(s) / SUM(n) AS avg_confidence FROM {name}_each GROUP BY fact_type, fact_value HAVING COUNT(*) > 1)"


def _pairs(name: str) -> str:
    return f"{name}_pairs AS (SELECT a.fact_type, a.fact_value, a.person_id AS p1, b.person_id AS p2, g.avg_confidence FROM {name} g JOIN {name}_each a ON a.fact_type = g.fact_type AND a.fact_value = g.fact_value JOIN {name}_each b ON b.fact_type = g.fact_type AND b.fact_value = g.fact_value AND a.person_id < b.person_id WHERE g.person_count <= 50)"


HARD = _groups("hard", ident.HARD)
TIER1 = _groups("tier1", ident.TIER1, NORMAL)
SOFT = _groups("soft", ident.SOFT_WEIGHTS)
WEIGHTS = "CASE fact_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ident.SOFT_WEIGHTS.items()) + " END"
SCORES = f"scores AS (SELECT p1, p2, CAST(SUM(CAST({WEIGHTS} AS DECIMAL(6, 2))) AS DOUBLE) AS score FROM soft_pairs GROUP BY p1, p2)"
COMPOUND = """compound AS (
SELECT DISTINCT a.person_id AS p1, b.person_id AS p2, 'name_birthdate' AS compound_type, CAST(0.9 AS DOUBLE) AS confidence FROM facts a JOIN facts b ON a.fact_value = b.fact_value AND a.person_id < b.person_id AND b.fact_type = 'full_legal_name' JOIN facts c ON c.person_id = a.person_id AND c.fact_type = 'birthdate' JOIN facts d ON d.person_id = b.person_id AND d.fact_type = 'birthdate' AND c.fact_value = d.fact_value WHERE a.fact_type = 'full_legal_name'
UNION ALL
SELECT DISTINCT a.person_id, b.person_id, 'name_employer_city', CAST(0.85 AS DOUBLE) FROM facts a JOIN facts b ON a.fact_type = b.fact_type AND a.fact_value = b.fact_value AND a.person_id < b.person_id JOIN facts c ON c.person_id = a.person_id AND c.fact_type = 'employer_current' JOIN facts d ON d.person_id = b.person_id AND d.fact_type = 'employer_current' AND c.fact_value = d.fact_value JOIN facts e ON e.person_id = a.person_id AND e.fact_type = 'location_current' JOIN facts f ON f.person_id = b.person_id AND f.fact_type = 'location_current' AND e.fact_value = f.fact_value WHERE a.fact_type IN ('full_legal_name', 'given_name'))"""
SUGGESTED = f"""{HARD}, {_pairs('hard')}, {SOFT}, {_pairs('soft')}, {SCORES}, {COMPOUND},
every AS (SELECT p1, p2, 1 AS phase, 'hard_identifier' AS merge_type, avg_confidence AS similarity_score, avg_confidence >= 0.8 AS auto_eligible FROM hard_pairs
UNION ALL SELECT p1, p2, 2, 'compound', confidence, TRUE FROM compound
UNION ALL SELECT p1, p2, 3, 'soft_accumulation', score, FALSE FROM scores WHERE score >= 0.6 - 1e-9),
suggested AS (SELECT p1, p2, merge_type, similarity_score, auto_eligible FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p1, p2 ORDER BY phase, similarity_score DESC) AS r FROM every) WHERE r = 1)"""


@query(f"WITH {FACTS}, {HARD} SELECT fact_type, fact_value, person_count, round(avg_confidence, 9) AS avg_confidence FROM hard")
def hard_collisions(spark, sf_dir):
    return ident.hard_collisions(facts(spark, sf_dir)).select("fact_type", "fact_value", "person_count", F.round("avg_confidence", 9).alias("avg_confidence"))


@query(f"WITH {FACTS}, {TIER1} SELECT t.fact_type, t.fact_value, t.person_count, round(t.avg_confidence, 9) AS avg_confidence, e.person_id FROM tier1 t JOIN tier1_each e ON e.fact_type = t.fact_type AND e.fact_value = t.fact_value")
def tier1_collisions(spark, sf_dir):
    return ident.collision_members(facts(spark, sf_dir), ident.TIER1, normalize=True).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"WITH {FACTS}, {HARD}, {_pairs('hard')} SELECT fact_type, fact_value, p1, p2 FROM hard_pairs")
def pairs_capped(spark, sf_dir):
    return ident.pairs(ident.hard_collisions(facts(spark, sf_dir)), "fact_type", "fact_value")


@query(f"WITH {FACTS}, {COMPOUND} SELECT * FROM compound")
def compound_matches(spark, sf_dir):
    return ident.compound_matches(facts(spark, sf_dir))


@query(f"WITH {FACTS}, {SOFT}, {_pairs('soft')}, {SCORES} SELECT * FROM scores WHERE score >= 0.4 - 1e-9")
def soft_scores(spark, sf_dir):
    return ident.soft_scores(facts(spark, sf_dir))


@query(f"WITH {FACTS}, {SUGGESTED} SELECT p1, p2, merge_type, round(similarity_score, 9) AS similarity_score, auto_eligible FROM suggested")
def merge_suggestions(spark, sf_dir):
    return ident.merge_suggestions(facts(spark, sf_dir)).withColumn("similarity_score", F.round("similarity_score", 9))


@query(f"WITH {FACTS}, {SUGGESTED} SELECT p1, p2, merge_type FROM suggested WHERE merge_type != 'soft_accumulation' AND NOT (merge_type = 'hard_identifier' AND p1 LIKE 'c1%')")
def merge_suggestions_incremental(spark, sf_dir):
    first = ident.merge_suggestions(facts(spark, sf_dir), include_soft=False)
    known = first.where("merge_type = 'hard_identifier' AND p1 LIKE 'c1%'").select(F.col("p2").alias("p1"), F.col("p1").alias("p2"))
    return ident.merge_suggestions(facts(spark, sf_dir), known, include_soft=False).select("p1", "p2", "merge_type")


CONFLICTS = f"conflicts AS (SELECT DISTINCT s.p1, s.p2 FROM suggested s JOIN facts a ON a.person_id = s.p1 JOIN facts b ON b.person_id = s.p2 AND a.fact_type = b.fact_type WHERE a.fact_type IN ({_list(ident.UNIQUE_FACTS)}) GROUP BY s.p1, s.p2, a.fact_type HAVING COUNT(*) FILTER (WHERE a.fact_value = b.fact_value) = 0)"


@query(f"WITH {FACTS}, {SUGGESTED}, {CONFLICTS} SELECT p1, p2 FROM conflicts")
def merge_fact_conflicts(spark, sf_dir):
    return ident.merge_suggestions(facts(spark, sf_dir), conflicts=True).where("conflict").select("p1", "p2")


@query(f"WITH RECURSIVE {FACTS}, {SUGGESTED}, {CONFLICTS}, good AS (SELECT s.p1, s.p2 FROM suggested s WHERE s.auto_eligible AND NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.p1 = s.p1 AND c.p2 = s.p2)), ends AS (SELECT p1 AS u, p2 AS v FROM good UNION SELECT p2, p1 FROM good), reach AS (SELECT u AS root, u AS node FROM ends UNION SELECT r.root, e.v FROM reach r JOIN ends e ON e.u = r.node) SELECT node AS person_id, MIN(root) AS canonical_id FROM reach GROUP BY node")
def merge_components(spark, sf_dir):
    return ident.suggested_components(facts(spark, sf_dir))


_DIFFER = f"len(list_filter([{_list(ident.UNIQUE_FACTS)}], lambda t: len(list_filter(held, lambda f: f.g = a AND f.t = t)) > 0 AND len(list_filter(held, lambda f: f.g = b AND f.t = t)) > 0 AND NOT list_has_any(list_transform(list_filter(held, lambda f: f.g = a AND f.t = t), lambda f: f.v), list_transform(list_filter(held, lambda f: f.g = b AND f.t = t), lambda f: f.v)))) > 0"


@query(f"""WITH RECURSIVE {FACTS}, {SUGGESTED}, edges AS MATERIALIZED (SELECT p1, p2, row_number() OVER (ORDER BY round(similarity_score, 6) DESC, p1, p2) AS i FROM suggested WHERE auto_eligible),
ends AS (SELECT p1 AS p FROM edges UNION SELECT p2 FROM edges),
walk AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list({{'p': p, 'g': p}}) FROM ends) AS groups, (SELECT list({{'g': person_id, 't': fact_type, 'v': fact_value}}) FROM (SELECT DISTINCT person_id, fact_type, fact_value FROM facts WHERE fact_type IN ({_list(ident.UNIQUE_FACTS)}) AND person_id IN (SELECT p FROM ends))) AS held
  UNION ALL SELECT i, CASE WHEN joins THEN list_transform(groups, lambda x: {{'p': x.p, 'g': CASE WHEN x.g = b THEN a ELSE x.g END}}) ELSE groups END, CASE WHEN joins THEN list_transform(held, lambda x: {{'g': CASE WHEN x.g = b THEN a ELSE x.g END, 't': x.t, 'v': x.v}}) ELSE held END
  FROM (SELECT *, a != b AND NOT {_DIFFER} AS joins FROM (SELECT i, groups, held, least(g1, g2) AS a, greatest(g1, g2) AS b FROM (SELECT e.i, groups, held, list_filter(groups, lambda x: x.p = e.p1)[1].g AS g1, list_filter(groups, lambda x: x.p = e.p2)[1].g AS g2 FROM walk w JOIN edges e ON e.i = w.i + 1))))
SELECT x.p AS person_id, x.g AS canonical_id FROM (SELECT unnest(groups) AS x FROM walk WHERE i = (SELECT COUNT(*) FROM edges))""")
def merges_in_order(spark, sf_dir):
    """Who is merged into whom when suggestions are decided one after another."""
    return ident.suggested_merges_in_order(facts(spark, sf_dir))


_NAMES = "persons AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS person_id, CASE WHEN c_custkey % 4 = 0 THEN 'Anna  Bell' ELSE 'anna bell' END || CAST(c_custkey % 211 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN ' Jr' ELSE '' END AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN 'Bell' || CAST(c_custkey % 211 AS VARCHAR) END AS display_name FROM customer)"
_FORM = "regexp_replace(trim(regexp_replace(regexp_replace(trim(lower({c})), ' jr$', ''), ' sr$', '')), '\\s+', ' ', 'g')"


def _named(spark, sf_dir):
    from tidemark.catalog.base import table

    return table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS person_id", "CASE WHEN c_custkey % 4 = 0 THEN 'Anna  Bell' ELSE 'anna bell' END || (c_custkey % 211) || CASE WHEN c_custkey % 5 = 0 THEN ' Jr' ELSE '' END AS canonical_name", "CASE WHEN c_custkey % 3 = 0 THEN 'Bell' || (c_custkey % 211) END AS display_name")


@query(f"WITH {_NAMES}, n AS (SELECT DISTINCT person_id, {_FORM.format(c='canonical_name')} AS name FROM persons UNION SELECT person_id, {_FORM.format(c='display_name')} FROM persons WHERE display_name IS NOT NULL), m AS (SELECT a.person_id AS p1, b.person_id AS p2, CASE WHEN a.name = b.name THEN 0.8 ELSE 0.6 END AS confidence, CASE WHEN a.name = b.name THEN 'exact' ELSE 'substring' END AS match FROM n a JOIN n b ON a.person_id < b.person_id WHERE length(a.name) >= 3 AND length(b.name) >= 3 AND (a.name = b.name OR ((contains(a.name, b.name) OR contains(b.name, a.name)) AND least(length(a.name), length(b.name)) >= 4 AND CAST(least(length(a.name), length(b.name)) AS DOUBLE) / greatest(length(a.name), length(b.name)) > 0.5))) SELECT p1, p2, MIN(match) AS match, CAST(MAX(confidence) AS DOUBLE) AS confidence FROM m GROUP BY p1, p2")
def name_similarity(spark, sf_dir):
    return ident.name_similarity(_named(spark, sf_dir))


@query(f"WITH {_NAMES}, n AS (SELECT DISTINCT person_id, name FROM (SELECT person_id, {_FORM.format(c='canonical_name')} AS name FROM persons UNION ALL SELECT person_id, {_FORM.format(c='display_name')} FROM persons WHERE display_name IS NOT NULL) WHERE length(name) >= 3), d AS (SELECT name, COUNT(*) AS members FROM n GROUP BY name), l AS (SELECT a.name AS short, b.name AS long FROM d a JOIN d b ON a.name != b.name AND contains(b.name, a.name) AND length(a.name) >= 4 AND CAST(length(a.name) AS DOUBLE) / length(b.name) > 0.5), c AS (SELECT name, COUNT(*) AS links FROM (SELECT short AS name FROM l UNION ALL SELECT long FROM l) GROUP BY name) SELECT person_id, n.name, members, COALESCE(links, 0) AS links FROM n JOIN d ON d.name = n.name LEFT JOIN c ON c.name = n.name")
def name_classes(spark, sf_dir):
    return ident.name_classes(_named(spark, sf_dir))


@query(f"WITH {FACTS}, d AS (SELECT DISTINCT person_id, split_part(lower(fact_value), '@', 2) AS domain FROM facts WHERE fact_type = 'email_personal'), n AS (SELECT domain, COUNT(*) AS members FROM d GROUP BY domain HAVING COUNT(*) > 1) SELECT person_id, domain, members FROM d JOIN n USING (domain)")
def domain_members(spark, sf_dir):
    return ident.domain_members(facts(spark, sf_dir).where("fact_type = 'email_personal'").selectExpr("person_id", "fact_value AS email"))


@query(f"WITH {FACTS}, nb AS (SELECT DISTINCT n.person_id, 'name_birthdate' AS kind, n.fact_value || '|' || b.fact_value AS k FROM facts n JOIN facts b USING (person_id) WHERE n.fact_type = 'full_legal_name' AND b.fact_type = 'birthdate'), nec AS (SELECT DISTINCT n.person_id, 'name_employer_city' AS kind, n.fact_type || '|' || n.fact_value || '|' || e.fact_value || '|' || l.fact_value AS k FROM facts n JOIN facts e USING (person_id) JOIN facts l USING (person_id) WHERE n.fact_type IN ('full_legal_name', 'given_name') AND e.fact_type = 'employer_current' AND l.fact_type = 'location_current'), every AS (SELECT * FROM nb UNION ALL SELECT * FROM nec) SELECT DISTINCT person_id, kind AS compound_type, class_id, members FROM every JOIN (SELECT kind, k, MIN(person_id) AS class_id, COUNT(DISTINCT person_id) AS members FROM every GROUP BY kind, k HAVING COUNT(DISTINCT person_id) > 1) USING (kind, k)")
def compound_members(spark, sf_dir):
    return ident.compound_members(facts(spark, sf_dir))


@query(f"WITH {FACTS}, d AS (SELECT DISTINCT person_id, split_part(lower(fact_value), '@', 2) AS domain FROM facts WHERE fact_type = 'email_personal') SELECT a.person_id AS p1, b.person_id AS p2, MIN(a.domain) AS domain, CAST(0.5 AS DOUBLE) AS confidence FROM d a JOIN d b ON a.domain = b.domain AND a.person_id < b.person_id GROUP BY a.person_id, b.person_id")
def shared_domain(spark, sf_dir):
    emails = facts(spark, sf_dir).where("fact_type = 'email_personal'").selectExpr("person_id", "fact_value AS email")
    return ident.shared_domain(emails)


@query(f"WITH {FACTS}, {SUGGESTED}, cross_channel AS (SELECT person_id FROM facts WHERE source_channel IS NOT NULL GROUP BY person_id HAVING COUNT(DISTINCT source_channel) >= 2) SELECT (SELECT COUNT(DISTINCT person_id) FROM facts) AS active_persons, CAST(0 AS BIGINT) AS merged_persons, (SELECT COUNT(*) FROM facts) AS total_facts, (SELECT COUNT(*) FROM facts WHERE fact_type IN ({_list(ident.HARD)})) AS hard_identifiers, (SELECT COUNT(*) FROM suggested) AS pending_merges, (SELECT COUNT(*) FROM suggested WHERE auto_eligible) AS auto_eligible_merges, (SELECT COUNT(*) FROM facts WHERE source_channel IS NULL) AS unresolved_facts, (SELECT COUNT(*) FROM cross_channel) AS cross_channel_linked")
def resolution_stats(spark, sf_dir):
    own = ident.flags(facts(spark, sf_dir))
    persons = own.select("person_id", F.col("person_id").alias("canonical_name")).distinct()
    merges = ident.merge_suggestions(own).withColumn("status", F.lit("pending"))
    return ident.stats(persons, own, merges, own.where("source_channel IS NULL").withColumn("resolved_to_person_id", F.lit(None).cast("string")))


@query(f"WITH {FACTS} SELECT person_id, fact_type, fact_value, MAX(confidence) AS confidence FROM (SELECT person_id, fact_type, fact_value, confidence FROM facts UNION ALL SELECT person_id, fact_type, fact_value, 0.6 FROM facts WHERE fact_type IN ('profession', 'given_name', 'email_personal') UNION ALL SELECT person_id, 'nickname', 'nick', 0.3 FROM facts WHERE fact_type = 'ssn') GROUP BY person_id, fact_type, fact_value")
def fact_upsert(spark, sf_dir):
    own = facts(spark, sf_dir).selectExpr("person_id", "'general' AS category", "fact_type", "fact_value", "confidence", "1L AS created_at", "1L AS updated_at")
    new = own.where("fact_type IN ('profession', 'given_name', 'email_personal')").withColumn("confidence", F.lit(0.6)).unionByName(own.where("fact_type = 'ssn'").withColumn("fact_type", F.lit("nickname")).withColumn("fact_value", F.lit("nick")).withColumn("confidence", F.lit(0.3))).withColumn("updated_at", F.lit(2).cast("long"))
    return ident.upsert_facts(own, new).select("person_id", "fact_type", "fact_value", "confidence")
