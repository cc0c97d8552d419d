"""Episodes and the event ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import LEDGER, TURNS, ledger, query, turns
from tidemark.operators import encode, episodes

GAP = 10_800


def _gap(key: str, gap: int = GAP, where: str = "TRUE") -> str:
    return f"""WITH {LEDGER},
starts AS (SELECT *, {key} AS k, CASE WHEN ts - LAG(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) <= {gap} THEN 0 ELSE 1 END AS s FROM ledger WHERE {where}),
grouped AS (SELECT *, SUM(s) OVER (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM starts),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, g ORDER BY ts, event_id) AS position, ROW_NUMBER() OVER (PARTITION BY k, g ORDER BY ts DESC, event_id DESC) AS last FROM grouped)
"""


_SUMMARY = "SELECT k AS scope_key, CAST(MIN(ts) AS BIGINT) AS start_time, CAST(MAX(ts) AS BIGINT) AS end_time, COUNT(*) AS event_count, MIN(CASE WHEN position = 1 THEN event_id END) AS first_event_id, MIN(CASE WHEN last = 1 THEN event_id END) AS last_event_id FROM placed GROUP BY k, g"


def _summary(members, key):
    return episodes.rows(members, "q").select(F.col(key).cast("string").alias("scope_key"), "start_time", "end_time", "event_count", "first_event_id", "last_event_id")


@query(_gap("CAST(thread_id AS VARCHAR)") + _SUMMARY)
def time_gap_episodes(spark, sf_dir):
    return _summary(episodes.time_gap(ledger(spark, sf_dir), GAP), "thread_id")


@query(_gap("channel", 1800) + _SUMMARY)
def time_gap_channel_episodes(spark, sf_dir):
    return _summary(episodes.time_gap(ledger(spark, sf_dir), 1800, scope="channel"), "channel")


@query(_gap("CAST(thread_id AS VARCHAR)", 86400) + "SELECT event_id, CAST(position AS INTEGER) AS position FROM (SELECT *, COUNT(*) OVER (PARTITION BY k, g) AS n FROM placed) WHERE n >= 3")
def time_gap_positions_min_size(spark, sf_dir):
    return episodes.time_gap(ledger(spark, sf_dir), 86400, least_events=3).select("event_id", "position")


@query(f"WITH {LEDGER}, placed AS (SELECT thread_id, event_id, ts, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS position, ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY ts DESC, event_id DESC) AS last FROM ledger) SELECT CAST(thread_id AS VARCHAR) AS scope_key, CAST(MIN(ts) AS BIGINT) AS start_time, CAST(MAX(ts) AS BIGINT) AS end_time, COUNT(*) AS event_count, MIN(CASE WHEN position = 1 THEN event_id END) AS first_event_id, MIN(CASE WHEN last = 1 THEN event_id END) AS last_event_id FROM placed GROUP BY thread_id")
def thread_episodes(spark, sf_dir):
    return _summary(episodes.by_thread(ledger(spark, sf_dir)), "thread_id")


@query(f"WITH {LEDGER} SELECT event_id, ts, thread_id, 1 AS position FROM ledger WHERE channel = 'purchase'")
def single_event_episodes(spark, sf_dir):
    return episodes.single_events(ledger(spark, sf_dir), channel="purchase").select("event_id", "ts", "thread_id", "position")


def _turns(tools: bool) -> str:
    where = "" if tools else "AND direction IN ('sent', 'received')"
    return f"WITH {TURNS}, n AS (SELECT *, SUM(CASE WHEN direction = 'sent' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM turns) SELECT thread_id, CAST(turn AS BIGINT) AS turn, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY thread_id, turn ORDER BY ts, event_id) AS INTEGER) AS position FROM n WHERE turn > 0 {where}"


@query(_turns(False))
def turn_pairs(spark, sf_dir):
    return episodes.turn_pairs(turns(spark, sf_dir)).select("thread_id", "turn", "event_id", "position")


@query(_turns(True))
def turn_pairs_with_tools(spark, sf_dir):
    return episodes.turn_pairs(turns(spark, sf_dir), include_tools=True).select("thread_id", "turn", "event_id", "position")


@query(f"WITH {LEDGER}, c AS (SELECT thread_id, event_id, ts, CAST((ROW_NUMBER() OVER (PARTITION BY thread_id ORDER BY ts, event_id) - 1) // 20 AS BIGINT) AS chunk FROM ledger), n AS (SELECT *, COUNT(*) OVER (PARTITION BY thread_id, chunk) AS n, ROW_NUMBER() OVER (PARTITION BY thread_id, chunk ORDER BY ts, event_id) AS position FROM c) SELECT thread_id, event_id, CAST(position AS INTEGER) AS position FROM n WHERE n >= 5")
def count_episodes(spark, sf_dir):
    return episodes.by_count(ledger(spark, sf_dir), 20, least_events=5).select("thread_id", "event_id", "position")


@query(f"WITH {LEDGER} SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY channel, ts // 86400 ORDER BY ts, event_id) AS INTEGER) AS position FROM ledger")
def daily_episodes(spark, sf_dir):
    return episodes.by_window(ledger(spark, sf_dir)).select("event_id", "position")


@query(_gap("channel", 1800) + ", e AS (SELECT k AS channel, MIN(ts) AS start_time, MIN(CASE WHEN position = 1 THEN event_id END) AS first_event_id FROM placed GROUP BY k, g), r AS (SELECT channel, first_event_id, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY start_time, first_event_id) AS n FROM e) SELECT a.first_event_id, b.first_event_id AS previous_event_id, CAST(a.n - b.n AS INTEGER) AS rank FROM r a JOIN r b ON a.channel = b.channel AND a.n > b.n AND a.n - b.n <= 3")
def episode_lookback(spark, sf_dir):
    rows = episodes.rows(episodes.time_gap(ledger(spark, sf_dir), 1800, scope="channel"), "q").select(F.col("first_event_id").alias("episode_id"), "channel", "start_time")
    return episodes.before_each(rows, 3).select(F.col("episode_id").alias("first_event_id"), F.col("previous_id").alias("previous_event_id"), "rank")


@query(f"WITH {LEDGER}, c AS (SELECT thread_id, ts, event_id FROM ledger WHERE event_id = 500), n AS (SELECT l.event_id, l.ts, (l.ts, l.event_id) > (c.ts, c.event_id) AS later FROM ledger l JOIN c ON l.thread_id = c.thread_id), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY later ORDER BY CASE WHEN later THEN ts ELSE -ts END, CASE WHEN later THEN event_id ELSE -event_id END) AS k FROM n) SELECT event_id, ts, CAST(ROW_NUMBER() OVER (ORDER BY ts, event_id) AS INTEGER) AS place FROM r WHERE (later AND k <= 5) OR (NOT later AND k <= 6)")
def events_around(spark, sf_dir):
    return episodes.around(ledger(spark, sf_dir), 500, 5, 5).select("event_id", "ts", "place")


@query(f"WITH {LEDGER} SELECT event_id, COUNT(*) FILTER (WHERE direction = 'sent') OVER (PARTITION BY thread_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent_before FROM ledger")
def sent_before(spark, sf_dir):
    return episodes.sent_before(ledger(spark, sf_dir)).select("event_id", "sent_before")


@query(_gap("channel", 1800) + ", f AS (SELECT k, g, thread_id, MIN(position) AS first FROM placed GROUP BY k, g, thread_id) SELECT CAST(first AS INTEGER) AS first, thread_id AS contact_id, k AS channel, 'Participant' || CAST(ROW_NUMBER() OVER (PARTITION BY k, g ORDER BY first, thread_id) AS VARCHAR) AS label FROM f")
def mask_labels(spark, sf_dir):
    events = ledger(spark, sf_dir)
    members = episodes.time_gap(events, 1800, scope="channel").withColumn("contact_id", F.col("thread_id"))
    firsts = members.groupBy("episode_id", "contact_id").agg(F.min("position").alias("first"), F.first("channel").alias("channel"))
    return episodes.mask_labels(members).join(firsts, ["episode_id", "contact_id"]).select("first", "contact_id", "channel", "label")


@query(f"WITH {TURNS}, n AS (SELECT *, SUM(CASE WHEN direction = 'sent' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM turns) SELECT thread_id, CAST(turn AS BIGINT) AS turn, string_agg(CASE WHEN direction = 'received' THEN 'Assistant: ' ELSE 'User: ' END || trim(content, ' '), chr(10) ORDER BY ts, event_id) || chr(10) AS text FROM n WHERE turn > 0 AND direction IN ('sent', 'received') AND trim(content, ' ') != '' GROUP BY thread_id, turn")
def turn_texts(spark, sf_dir):
    events = turns(spark, sf_dir).withColumn("content_types", F.array(F.lit("text")))
    members = episodes.turn_pairs(events)
    text = encode.episode_texts(members, encode.turn_quality_lines(events))
    keys = members.groupBy("episode_id").agg(F.first("thread_id").alias("thread_id"), F.first("turn").alias("turn"))
    return text.join(keys, "episode_id").select("thread_id", "turn", "text")
