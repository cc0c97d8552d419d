"""Registration, and how the test tables stand for a ledger, a graph and facts.

The mapping is one of names: `events` are ledger events (thread and sender = user, channel = event
type, direction by a fixed rule), `conversations` are threads of turns, `customer` and `supplier`
are persons and entities, `orders` are links and edges, `documents` document heads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Epoch seconds of a time without zone, whatever the session's zone."""
    return F.expr(f"datediff(cast({ts} as date), date'1970-01-01') * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L + second({ts})")


DIRECTION = "CASE event_type WHEN 'click' THEN 'sent' WHEN 'purchase' THEN 'sent' WHEN 'view' THEN 'received' ELSE 'observed' END"
LEDGER = f"ledger AS (SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, event_type AS channel, {DIRECTION} AS direction, user_id AS thread_id, props AS content, user_id AS contact_id FROM events)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", seconds("ts").alias("ts"), F.col("event_type").alias("channel"), F.expr(DIRECTION).alias("direction"), F.col("user_id").alias("thread_id"), F.col("props").alias("content"), F.col("user_id").alias("contact_id"))


TURN_DIRECTION = "CASE role WHEN 'user' THEN 'sent' WHEN 'assistant' THEN 'received' ELSE 'observed' END"
TURNS = f"turns AS (SELECT conv_id * 1000 + turn AS event_id, turn AS ts, 'chat' AS channel, {TURN_DIRECTION} AS direction, conv_id AS thread_id, text AS content FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("event_id"), F.col("turn").alias("ts"), F.lit("chat").alias("channel"), F.expr(TURN_DIRECTION).alias("direction"), F.col("conv_id").alias("thread_id"), F.col("text").alias("content"))


PERSONS = "persons AS (SELECT c_custkey AS person_id, c_name AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN 'Client ' || CAST(c_custkey AS VARCHAR) END AS display_name, c_custkey = 1 AS is_me FROM customer)"
LINKS = "links AS (SELECT o_custkey AS person_id, o_custkey // 10 AS contact_id, MAX(o_totalprice) / 1000000 AS confidence, CAST(MAX(epoch_us(o_orderdate) // 1000000) AS BIGINT) AS last_seen_at FROM orders GROUP BY o_custkey)"
CONTACTS = "contacts AS (SELECT DISTINCT user_id AS contact_id, CASE WHEN user_id % 2 = 0 THEN 'User ' || CAST(user_id AS VARCHAR) END AS display_name FROM events)"
IDENTIFIERS = "identifiers AS (SELECT contact_id, 'phone' AS type, '+1555' || CAST(1000000 + contact_id AS VARCHAR) AS value FROM contacts WHERE contact_id % 5 < 3 UNION ALL SELECT contact_id, 'email', 'user' || CAST(contact_id AS VARCHAR) || '@mail.example' FROM contacts WHERE contact_id % 4 > 0)"
PEOPLE = ",\n".join((LEDGER, PERSONS, LINKS, CONTACTS, IDENTIFIERS))


def persons(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", "c_name AS canonical_name", "CASE WHEN c_custkey % 3 = 0 THEN 'Client ' || c_custkey END AS display_name", "c_custkey = 1 AS is_me")


def links(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg((F.max("o_totalprice") / 1000000).alias("confidence"), F.max(seconds("o_orderdate")).alias("last_seen_at")).select("person_id", F.expr("person_id div 10").alias("contact_id"), "confidence", "last_seen_at")


def contacts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("contact_id")).distinct().selectExpr("contact_id", "CASE WHEN contact_id % 2 = 0 THEN 'User ' || contact_id END AS display_name")


def identifiers(spark, sf_dir):
    own = contacts(spark, sf_dir)
    phones = own.where("contact_id % 5 < 3").selectExpr("contact_id", "'phone' AS type", "'+1555' || (1000000 + contact_id) AS value")
    return phones.union(own.where("contact_id % 4 > 0").selectExpr("contact_id", "'email'", "'user' || contact_id || '@mail.example'"))


def participants(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS contact_id", "'sender' AS role")


# --- facts ---

_PEOPLE_SQL = "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS person_id, c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_suppkey, s_nationkey, 'SUPPLY' FROM supplier"
#: Fact types, the expression of the value, the confidence, and for which people.
_FACTS = [
    ("email_personal", "CASE WHEN k % 2 = 0 THEN 'Mail' ELSE 'mail' END || CAST(k % 700 AS {s}) || '@n' || CAST(nation % 5 AS {s}) || '.example'", "0.9", "k % 3 < 2"),
    ("phone_mobile", "CASE WHEN k % 2 = 0 THEN '+1 (555) ' ELSE '1555' END || CAST(1000000 + k % 900 AS {s})", "0.7 + (k % 4) * 0.0625", "k % 4 < 3"),
    ("social_twitter", "CASE WHEN k % 2 = 0 THEN '@' ELSE '' END || 'name' || CAST(k % 1100 AS {s})", "0.8", "k % 5 = 0"),
    ("full_legal_name", "'Person ' || CAST(k % 600 AS {s})", "0.75", "k % 2 = 0"),
    ("given_name", "'P' || CAST(k % 90 AS {s})", "0.5", "k % 2 = 1"),
    ("birthdate", "CAST(1950 + k % 50 AS {s}) || '-01-' || CAST(10 + k % 18 AS {s})", "0.5", "k % 3 > 0"),
    ("employer_current", "segment || '-' || CAST(k % 40 AS {s})", "0.5", "TRUE"),
    ("location_current", "'N' || CAST(nation AS {s}) || '-' || CAST(k % 10 AS {s})", "0.5", "TRUE"),
    ("profession", "'job' || CAST(k % 55 AS {s})", "0.25", "k % 2 = 0"),
    ("spouse_first_name", "'S' || CAST(k % 450 AS {s})", "0.5", "k % 3 = 0"),
    ("school_attended", "'school' || CAST(k % 35 AS {s})", "0.5", "k % 4 = 1"),
    ("ssn", "CAST(100000000 + k AS {s})", "1.0", "k % 400 < 3"),
]


def _facts_sql(string: str) -> str:
    return " UNION ALL ".join(f"SELECT person_id, '{t}' AS fact_type, {v.format(s=string)} AS fact_value, CAST({c} AS DOUBLE) AS confidence, CASE WHEN k % 3 = 0 THEN 'mail' WHEN k % 3 = 1 THEN 'chat' END AS source_channel FROM people WHERE {w}" for t, v, c, w in _FACTS)


FACTS = f"people AS ({_PEOPLE_SQL}), facts AS ({_facts_sql('VARCHAR')})"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS person_id", "c_custkey AS k", "c_nationkey AS nation", "c_mktsegment AS segment")
    s = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS person_id", "s_suppkey AS k", "s_nationkey AS nation", "'SUPPLY' AS segment")
    # All facts of a person in one pass.
    each = ", ".join(f"CASE WHEN {where} THEN named_struct('fact_type', '{t}', 'fact_value', {v.format(s='STRING')}, 'confidence', CAST({conf} AS DOUBLE)) END" for t, v, conf, where in _FACTS)
    people = c.union(s).selectExpr("person_id", "CASE WHEN k % 3 = 0 THEN 'mail' WHEN k % 3 = 1 THEN 'chat' END AS source_channel", f"array_compact(array({each})) AS own")
    return people.withColumn("f", F.explode("own")).select("person_id", "f.fact_type", "f.fact_value", "f.confidence", "source_channel")


# --- graph ---

_ENTITY = "SELECT 'c' || CAST(c_custkey AS {s}) AS entity_id, c_name AS canonical_name, 1 AS entity_type_id, CASE WHEN c_custkey % 50 = 7 THEN 'c' || CAST(c_custkey - 1 AS {s}) END AS merged_into, c_custkey AS k FROM customer UNION ALL SELECT 's' || CAST(s_suppkey AS {s}), s_name, 2, CASE WHEN s_suppkey % 25 = 3 THEN 's' || CAST(s_suppkey - 1 AS {s}) END, s_suppkey FROM supplier"
_RELATION = "CASE o_orderkey % 5 WHEN 0 THEN 'WORKS_AT' WHEN 1 THEN 'LIVES_IN' WHEN 2 THEN 'BORN_ON' WHEN 3 THEN 'ORDERED_FROM' ELSE 'KNOWS' END"
_EDGES = "SELECT 'r' || CAST(o_orderkey AS {s}) AS relationship_id, 'c' || CAST(o_custkey AS {s}) AS source_entity_id, CASE WHEN o_orderkey % 5 IN (0, 3) THEN 's' || CAST(o_orderkey % 100 AS {s}) WHEN o_orderkey % 5 = 4 THEN 'c' || CAST(o_orderkey % 997 AS {s}) END AS target_entity_id, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'L' || CAST(o_orderkey % 61 AS {s}) END AS target_literal, {r} AS relation_type, CASE WHEN o_orderkey % 11 > 0 THEN {d} END AS valid_at, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN {d2} END AS invalid_at, {d} AS created_at, 1.0 AS confidence FROM orders"
ENTITIES = f"entities AS ({_ENTITY.format(s='VARCHAR')})"
EDGES = f"relationships AS ({_EDGES.format(s='VARCHAR', r=_RELATION, d='strftime(o_orderdate, $$%Y-%m-%d$$)', d2='strftime(o_orderdate + INTERVAL 400 DAY, $$%Y-%m-%d$$)')})".replace("$$", "'")
_ALIASES = "SELECT entity_id, canonical_name AS alias, 'name' AS alias_type, 'name ' || CAST(k % 600 AS {s}) AS normalized FROM entities UNION ALL SELECT entity_id, 'm' || CAST(k % 700 AS {s}) || '@x.example', 'email', 'm' || CAST(k % 700 AS {s}) || '@x.example' FROM entities WHERE k % 3 < 2 UNION ALL SELECT entity_id, '+1555' || CAST(1000000 + k % 900 AS {s}), 'phone', '+1555' || CAST(1000000 + k % 900 AS {s}) FROM entities WHERE k % 4 < 3"
ALIASES = f"aliases AS ({_ALIASES.format(s='VARCHAR')})"


def entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS entity_id", "c_name AS canonical_name", "1 AS entity_type_id", "CASE WHEN c_custkey % 50 = 7 THEN 'c' || (c_custkey - 1) END AS merged_into", "c_custkey AS k")
    s = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS entity_id", "s_name AS canonical_name", "2 AS entity_type_id", "CASE WHEN s_suppkey % 25 = 3 THEN 's' || (s_suppkey - 1) END AS merged_into", "s_suppkey AS k")
    return c.union(s)


def relationships(spark, sf_dir):
    text = _EDGES.format(s="STRING", r=_RELATION, d="date_format(o_orderdate, 'yyyy-MM-dd')", d2="date_format(o_orderdate + INTERVAL 400 DAY, 'yyyy-MM-dd')")
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")).withColumn("fact", F.col("relation_type"))


def aliases(spark, sf_dir):
    return spark.sql(_ALIASES.format(s="STRING").replace("FROM entities", "FROM {entities}"), entities=entities(spark, sf_dir)).withColumn("is_shared", F.lit(False))
