"""Events, people and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import LEDGER, LINKS, PEOPLE, PERSONS, contacts, identifiers, ledger, links, participants, persons, query, table
from tidemark.operators import events as ev
from tidemark.operators import tags as tg

JAN_10, JAN_20 = 1704844800, 1705708800
BEST = "best AS (SELECT contact_id, person_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY contact_id ORDER BY confidence DESC, last_seen_at DESC, person_id DESC) AS r FROM links) WHERE r = 1)"
IDENT = "ident AS (SELECT contact_id, value AS identifier FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY contact_id ORDER BY CASE type WHEN 'phone' THEN 1 ELSE 2 END, value) AS r FROM identifiers) WHERE r = 1)"
LABELS = "labels AS (SELECT c.contact_id, b.person_id, COALESCE(p.display_name, p.canonical_name, c.display_name, i.identifier, 'Unknown') AS label FROM contacts c LEFT JOIN best b ON b.contact_id = c.contact_id LEFT JOIN persons p ON p.person_id = b.person_id LEFT JOIN ident i ON i.contact_id = c.contact_id)"
ALL = ",\n".join((PEOPLE, BEST, IDENT, LABELS))


def _labels(spark, sf_dir, use="timeline"):
    return ev.labels(contacts(spark, sf_dir), links(spark, sf_dir), persons(spark, sf_dir), identifiers(spark, sf_dir), use=use)


@query(f"WITH {ALL} SELECT * FROM best")
def best_link(spark, sf_dir):
    return ev.best_link(links(spark, sf_dir))


@query(f"WITH {ALL} SELECT * FROM ident")
def best_identifier(spark, sf_dir):
    return ev.best_identifier(identifiers(spark, sf_dir))


@query(f"WITH {ALL} SELECT * FROM labels")
def sender_label(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(f"WITH {ALL} SELECT c.contact_id, b.person_id, COALESCE(p.canonical_name, c.display_name, i.identifier, 'Unknown') AS label FROM contacts c LEFT JOIN best b ON b.contact_id = c.contact_id LEFT JOIN persons p ON p.person_id = b.person_id LEFT JOIN ident i ON i.contact_id = c.contact_id")
def episode_label(spark, sf_dir):
    return _labels(spark, sf_dir, "episode")


@query(f"WITH {LEDGER} SELECT event_id, ts, channel, direction, thread_id FROM ledger WHERE channel = 'purchase' AND direction = 'sent' AND ts >= {JAN_10} AND ts <= {JAN_20} ORDER BY ts DESC, event_id LIMIT 50")
def event_filter(spark, sf_dir):
    f = ev.EventFilters(channel="purchase", direction="sent", since=JAN_10, until=JAN_20, limit=50)
    return ev.query_events(ledger(spark, sf_dir), f).select("event_id", "ts", "channel", "direction", "thread_id")


@query(f"WITH {PEOPLE} SELECT event_id, ts, channel FROM (SELECT DISTINCT l.event_id, l.ts, l.channel FROM ledger l JOIN links k ON k.contact_id = l.contact_id JOIN persons p ON p.person_id = k.person_id WHERE lower(p.canonical_name) LIKE '%00001_%' OR lower(p.display_name) LIKE '%00001_%') ORDER BY ts DESC, event_id LIMIT 100")
def event_filter_person_recent(spark, sf_dir):
    return ev.query_events(ledger(spark, sf_dir), ev.EventFilters(person="00001_"), participants(spark, sf_dir), links(spark, sf_dir), persons(spark, sf_dir)).select("event_id", "ts", "channel")


@query(f"WITH {ALL}, e AS (SELECT * FROM ledger WHERE channel = 'signup' ORDER BY ts DESC, event_id LIMIT 100) SELECT e.event_id, l.contact_id, l.label AS name, 'sender' AS role FROM e JOIN labels l ON l.contact_id = e.contact_id")
def event_participants(spark, sf_dir):
    chosen = ev.query_events(ledger(spark, sf_dir), ev.EventFilters(channel="signup")).drop("contact_id")
    out = ev.with_participants(chosen, participants(spark, sf_dir), _labels(spark, sf_dir))
    return out.select("event_id", F.inline("participants"))


@query(f"WITH {ALL} SELECT CAST(CAST(make_timestamp(l.ts * 1000000) AS DATE) AS VARCHAR) AS day, COALESCE(x.label, 'Unknown') AS sender, l.channel, l.direction, COUNT(*) AS n FROM ledger l LEFT JOIN labels x ON x.contact_id = l.contact_id WHERE l.ts >= {JAN_10} AND l.ts < {JAN_20} GROUP BY ALL")
def timeline_daily(spark, sf_dir):
    return ev.timeline(ledger(spark, sf_dir).drop("contact_id"), participants(spark, sf_dir), _labels(spark, sf_dir), JAN_10, JAN_20)


@query(f"WITH {LEDGER}, l AS (SELECT CAST(CAST(make_timestamp(ts * 1000000) AS DATE) AS VARCHAR) AS day, channel, direction FROM ledger WHERE ts >= {JAN_10} AND ts < {JAN_20}) SELECT day, 'channel' AS kind, channel AS name, COUNT(*) AS n FROM l GROUP BY day, channel UNION ALL SELECT day, 'direction', direction, COUNT(*) FROM l GROUP BY day, direction UNION ALL SELECT day, 'total', '', COUNT(*) FROM l GROUP BY day")
def timeline_daily_maps_flat(spark, sf_dir):
    events = ledger(spark, sf_dir).drop("contact_id")
    flat = ev.timeline(events, participants(spark, sf_dir), _labels(spark, sf_dir), JAN_10, JAN_20)
    days = ev.timeline_days(flat, ev.day_totals(events, JAN_10, JAN_20))
    return days.select("day", F.lit("channel").alias("kind"), F.explode("by_channel").alias("name", "n")).unionByName(days.select("day", F.lit("direction").alias("kind"), F.explode("by_direction").alias("name", "n"))).unionByName(days.select("day", F.lit("total").alias("kind"), F.lit("").alias("name"), F.col("total").alias("n")))


_COUNTS = f"WITH {PEOPLE}, seen AS (SELECT k.person_id, COUNT(DISTINCT l.event_id) AS event_count, MAX(l.ts) AS last_event_at FROM links k JOIN ledger l ON l.contact_id = k.contact_id GROUP BY k.person_id), people AS (SELECT p.person_id, p.canonical_name, p.is_me, COALESCE(s.event_count, 0) AS event_count, s.last_event_at FROM persons p LEFT JOIN seen s ON s.person_id = p.person_id)"


def _people(spark, sf_dir):
    return ev.people(persons(spark, sf_dir), links(spark, sf_dir), participants(spark, sf_dir), ledger(spark, sf_dir))


@query(_COUNTS + " SELECT person_id, canonical_name, event_count, last_event_at FROM people ORDER BY event_count DESC, canonical_name, person_id LIMIT 25")
def people_top(spark, sf_dir):
    return _people(spark, sf_dir).select("person_id", "canonical_name", "event_count", "last_event_at").limit(25)


@query(_COUNTS + " SELECT person_id, event_count FROM people WHERE NOT is_me AND event_count >= 5")
def frequent_persons(spark, sf_dir):
    from tidemark.operators.identity import frequent_persons as frequent

    return frequent(_people(spark, sf_dir), 5).select("person_id", "event_count")


@query(f"WITH {PEOPLE} SELECT person_id FROM persons WHERE lower(canonical_name) LIKE '%99%' OR lower(display_name) LIKE '%99%' UNION SELECT k.person_id FROM links k JOIN persons p ON p.person_id = k.person_id JOIN contacts c ON c.contact_id = k.contact_id WHERE lower(c.display_name) LIKE '%99%' UNION SELECT k.person_id FROM links k JOIN persons p ON p.person_id = k.person_id JOIN identifiers i ON i.contact_id = k.contact_id WHERE lower(i.value) LIKE '%99%'")
def people_search(spark, sf_dir):
    return ev.search_people(persons(spark, sf_dir), links(spark, sf_dir), identifiers(spark, sf_dir), contacts(spark, sf_dir), "99").select("person_id")


@query(f"WITH {LEDGER} SELECT thread_id, COUNT(*) AS event_count, MAX(channel) AS channel, MAX(ts) AS last_ts FROM ledger GROUP BY thread_id ORDER BY event_count DESC, thread_id LIMIT 20")
def top_threads(spark, sf_dir):
    return ev.top_threads(ledger(spark, sf_dir), 20).select("thread_id", "event_count", "channel", "last_ts")


@query(f"WITH {LEDGER} SELECT CASE WHEN channel = 'error' THEN 'context' ELSE 'topic' END AS tag_type, CASE WHEN channel = 'error' THEN 'broken' ELSE 'january' END AS value, COUNT(*) AS n FROM ledger WHERE channel = 'error' OR (ts >= {JAN_10} AND ts <= {JAN_20} AND channel = 'click') GROUP BY ALL")
def bulk_tags(spark, sf_dir):
    events = ledger(spark, sf_dir)
    none = spark.createDataFrame([], "event_id long, tag_type string, value string, confidence double, source string, created_at long")
    tagged = tg.add(none, tg.bulk_events(events, channel="error"), "context", "broken", 1)
    tagged = tg.add(tagged, tg.bulk_events(events, channel="click", since=JAN_10, until=JAN_20), "topic", "january", 2)
    # A second time adds nothing.
    return tg.counts(tg.add(tagged, tg.bulk_events(events, channel="error"), "context", "broken", 3))


@query(f"WITH {LINKS}, {PERSONS} SELECT p.person_id, MAX(k.confidence) AS confidence, MIN(k.last_seen_at) AS first_seen_at, MAX(k.last_seen_at) AS last_seen_at, k.contact_id FROM (SELECT * FROM links UNION ALL SELECT person_id, contact_id, confidence / 2, last_seen_at + 86400 FROM links WHERE person_id % 2 = 0) k JOIN persons p ON p.person_id = k.person_id GROUP BY p.person_id, k.contact_id")
def link_upsert(spark, sf_dir):
    from tidemark.operators.identity import upsert_links

    old = links(spark, sf_dir).withColumn("first_seen_at", F.col("last_seen_at"))
    new = old.where("person_id % 2 = 0").selectExpr("person_id", "contact_id", "confidence / 2 AS confidence", "last_seen_at + 86400 AS last_seen_at", "first_seen_at + 86400 AS first_seen_at")
    return upsert_links(old, new.select(*old.columns)).select("person_id", "confidence", "first_seen_at", "last_seen_at", "contact_id")


@query("SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment")
def raw_sql(spark, sf_dir):
    from tidemark.sources.files import raw_sql as run

    return run(spark, "WITH debtors AS (SELECT * FROM customer WHERE c_acctbal < 0) SELECT c_mktsegment AS segment, COUNT(*) AS n FROM debtors GROUP BY c_mktsegment", {"customer": table(spark, sf_dir, "customer")})
