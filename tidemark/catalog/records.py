"""Facets, runs, sources and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import ledger, query, table
from tidemark.functions import codes
from tidemark.functions import identity as fid
from tidemark.functions import shell
from tidemark.operators import facets, runs
from tidemark.sources import mail, sessions


@query("SELECT event_id AS run_id, 'k' AS facet_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def facet_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS run_id", "props AS output_text")
    return facets.extract_facets(rows, [("k", "k")], keep=("run_id",)).select("run_id", "facet_type", "value")


@query("SELECT o_orderkey AS run_id, 'status' AS facet_type, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'part', 'p' || CAST(i AS VARCHAR) FROM orders CROSS JOIN range(3) t(i) WHERE i <= o_orderkey % 3")
def facet_extract_arrays(spark, sf_dir):
    own = table(spark, sf_dir, "orders")
    body = F.expr("concat('Here:\n```json\n', to_json(named_struct('head', named_struct('status', o_orderstatus), 'items', transform(sequence(0, o_orderkey % 3), i -> named_struct('name', 'p' || i)))), '\n```')")
    rows = own.select(F.col("o_orderkey").alias("run_id"), body.alias("output_text"))
    return facets.extract_facets(rows, [("head.status", "status"), ("items[].name", "part")], keep=("run_id",))


@query("WITH log AS (SELECT event_type AS analysis_type, user_id AS episode_id, CASE CAST(round(value) AS INTEGER) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'blocked' ELSE 'failed' END AS status, event_id AS ts FROM events), latest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY analysis_type, episode_id ORDER BY ts DESC) AS r FROM log) SELECT analysis_type, status, COUNT(*) AS n FROM latest WHERE r = 1 GROUP BY analysis_type, status")
def analysis_status(spark, sf_dir):
    return runs.status_counts(_log(spark, sf_dir))


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_type AS analysis_type", "user_id AS episode_id", "CASE cast(round(value) as int) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'blocked' ELSE 'failed' END AS status", "event_id AS ts")


@query("WITH log AS (SELECT event_type AS analysis_type, user_id AS episode_id, CASE CAST(round(value) AS INTEGER) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'blocked' ELSE 'failed' END AS status, event_id AS ts FROM events WHERE event_type = 'error'), done AS (SELECT episode_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY episode_id ORDER BY ts DESC) AS r FROM log) WHERE r = 1 AND status IN ('completed', 'blocked')) SELECT DISTINCT user_id AS episode_id FROM events WHERE user_id NOT IN (SELECT episode_id FROM done)")
def analysis_work_list(spark, sf_dir):
    episodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id")).distinct()
    return runs.work_list(episodes, "error", _log(spark, sf_dir))


@query("SELECT event_type AS kind, COUNT(*) AS total, COUNT(*) FILTER (WHERE event_id % 3 = 0) AS succeeded, COUNT(*) FILTER (WHERE event_id % 3 = 1) AS failed, COUNT(*) FILTER (WHERE event_id % 3 = 2) AS blocked, round(AVG(event_id % 100), 6) AS avg_call_ms FROM events GROUP BY event_type")
def job_metrics(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").selectExpr("event_type AS kind", "element_at(array('succeeded', 'failed', 'blocked'), cast(event_id % 3 as int) + 1) AS outcome", "event_id % 100 AS call_ms")
    return runs.job_metrics(jobs).withColumn("avg_call_ms", F.round("avg_call_ms", 6))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts FROM events WHERE (CAST(epoch_us(ts) // 1000000 AS BIGINT), event_id) > (1704844800, 3000)")
def watermark_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir).select(F.col("event_id").alias("id"), "ts")
    return runs.after_watermark(rows, 1704844800, 3000).select(F.col("id").alias("event_id"), "ts")


@query("WITH v AS (SELECT c_custkey, '+1 (555) ' || CAST(1000000 + c_custkey AS VARCHAR) AS p, ' @' || c_name AS h, c_name || '@Mail.Example ' AS e FROM customer) SELECT c_custkey, '555' || CAST(1000000 + c_custkey AS VARCHAR) AS phone, lower(trim(h)) AS handle, lower(trim(e)) AS email, '+1555' || CAST(1000000 + c_custkey AS VARCHAR) AS alias_phone FROM v")
def identifier_forms(spark, sf_dir):
    v = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'+1 (555) ' || (1000000 + c_custkey) AS p", "' @' || c_name AS h", "c_name || '@Mail.Example ' AS e")
    one = lambda c, kind: fid.identifier(F.col(c), F.lit(kind))
    return v.select("c_custkey", one("p", "phone").alias("phone"), one("h", "handle").alias("handle"), one("e", "email").alias("email"), fid.alias(F.col("p"), F.lit("phone")).alias("alias_phone"))


def _commands(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS event_id", "event_id AS ts", "'session_tool' AS source_adapter", "'sudo -n env A=1 Git status \"' || event_type || '\" | grep -v x && npx -y tool' || (event_id % 3) || ' run ' || user_id || ' > out 2>&1; B=2 ./bin/Make' AS content", "cast(user_id as string) AS episode_id")


@query("WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, event_id AS n, user_id FROM events) SELECT event_id, 0 AS segment, 'git' AS binary, 'status' AS subcommand, event_type AS args, 'direct' AS kind FROM e UNION ALL SELECT event_id, 1, 'grep', '-v', 'x', 'direct' FROM e UNION ALL SELECT event_id, 2, 'tool' || CAST(n % 3 AS VARCHAR), 'run', CAST(user_id AS VARCHAR) || ' > out 2>&1', 'wrapper:npx' FROM e UNION ALL SELECT event_id, 3, 'make', NULL, NULL, 'direct' FROM e")
def shell_invocations(spark, sf_dir):
    events = _commands(spark, sf_dir)
    members = events.selectExpr("episode_id", "event_id", "1 AS position")
    return shell.report(events, members).select("event_id", "segment", "binary", "subcommand", "args", "kind")


@query("SELECT o_orderkey, CASE 2000 + o_orderkey % 8 WHEN 2000 THEN '❤️' WHEN 2001 THEN '👍' WHEN 2002 THEN '👎' WHEN 2003 THEN '😂' WHEN 2004 THEN '‼️' WHEN 2005 THEN '❓' ELSE 'reaction:' || CAST(2000 + o_orderkey % 8 AS VARCHAR) END AS reaction, CASE o_orderkey % 4 WHEN 1 THEN 'added' WHEN 3 THEN 'removed' ELSE 'unknown' END AS action, CASE WHEN o_orderkey % 10 = 0 THEN 'sticker' WHEN o_orderkey % 5 = 1 THEN 'image' WHEN o_orderkey % 5 = 2 THEN 'video' WHEN o_orderkey % 5 = 3 THEN 'audio' ELSE 'document' END AS media_type FROM orders")
def source_codes(spark, sf_dir):
    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "2000 + o_orderkey % 8 AS code", "o_orderkey % 4 AS act", "element_at(array('text/plain', 'IMAGE/png', 'video/mp4', 'audio/x', NULL), cast(o_orderkey % 5 as int) + 1) AS mime", "o_orderkey % 10 = 0 AS sticker")
    return own.select("o_orderkey", codes.reaction(F.col("code")).alias("reaction"), codes.group_action(F.col("act")).alias("action"), codes.media_type(F.col("mime"), F.col("sticker")).alias("media_type"))


@query("WITH m AS (SELECT o_orderkey AS event_id, o_orderkey % 7 AS k FROM orders) SELECT event_id, CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'unread' ELSE 'read' END AS read_state, k IN (2, 3) AS flagged, k NOT IN (1, 4) AS archived, CASE WHEN k = 5 THEN 'draft' WHEN event_id % 2 = 0 THEN 'sent' ELSE 'received' END AS status FROM m")
def mail_state(spark, sf_dir):
    labels = "element_at(array(array(), array('UNREAD', 'INBOX'), array('STARRED'), array('IMPORTANT'), array('INBOX'), array('DRAFT'), array('Other')), cast(o_orderkey % 7 as int) + 1)"
    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS event_id", f"cast({labels} as array<string>) AS labels", "CASE WHEN o_orderkey % 2 = 0 THEN 'sent' ELSE 'received' END AS direction")
    return mail.state(own)


def _session_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id * 1000 + turn as string) AS id", "cast(conv_id as string) AS session_id", "role", "text AS content", "cast(turn as int) AS sequence", "turn * 1500 AS timestamp", "cast(null as string) AS metadata_json")


@query("SELECT 'ai:' || CAST(conv_id * 1000 + turn AS VARCHAR) AS event_id, CAST(turn * 1500 // 1000 AS BIGINT) AS ts, CASE role WHEN 'user' THEN 'sent' WHEN 'assistant' THEN 'received' ELSE 'observed' END AS direction, 'ai:' || CAST(conv_id AS VARCHAR) AS thread_id FROM conversations WHERE trim(text, ' ') != '' AND turn * 1500 > 3000")
def session_messages(spark, sf_dir):
    rows = _session_rows(spark, sf_dir)
    own = rows.selectExpr("session_id AS id", "'ai' AS source", "'m' AS model", "0L AS created_at").distinct()
    return sessions.messages(rows, own, "ai", last_ts=3000).select("event_id", "ts", "direction", "thread_id")


@query("WITH t AS (SELECT conv_id, turn // 2 AS k, string_agg(trim(text, ' '), chr(10) || chr(10) ORDER BY turn, CAST(conv_id * 1000 + turn AS VARCHAR)) AS content FROM conversations WHERE role = 'user' AND trim(text, ' ') != '' GROUP BY conv_id, turn // 2) SELECT 'ai:' || CAST(conv_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) || ':user' AS event_id, CAST(k AS BIGINT) AS ts, content FROM t")
def session_turns(spark, sf_dir):
    rows = _session_rows(spark, sf_dir)
    ids = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn div 2 AS k", "cast(conv_id * 1000 + turn as string) AS id")
    turns = ids.groupBy("conv_id", "k").agg(F.to_json(F.sort_array(F.collect_list("id"))).alias("query_message_ids")).selectExpr("conv_id || '-' || k AS id", "cast(conv_id as string) AS session_id", "query_message_ids", "cast(null as string) AS response_message_id", "k * 1000 AS timestamp")
    return sessions.turn_events(turns, rows, "ai").select("event_id", "ts", "content")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 = 3 THEN TRUE ELSE o_orderkey % 4 = 1 END AS has_text FROM orders")
def content_types(spark, sf_dir):
    from tidemark.operators.events import has_content_type

    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS event_id", "element_at(array('[]', '[\"a\", \"text\"]', '[\"texts\"]', 'text only'), cast(o_orderkey % 4 as int) + 1) AS types")
    return own.select("event_id", has_content_type(F.col("types"), "text").alias("has_text"))


@query("WITH p AS (SELECT DISTINCT o_orderdate AS event_id, o_custkey // 40 AS person FROM orders) SELECT a.person AS p1, b.person AS p2, COUNT(*) AS n FROM p a JOIN p b ON a.event_id = b.event_id AND a.person < b.person GROUP BY a.person, b.person")
def co_occurrence(spark, sf_dir):
    from tidemark.operators.identity import co_occurrence as together

    own = table(spark, sf_dir, "orders")
    people = own.selectExpr("o_orderdate AS event_id", "o_custkey AS contact_id")
    return together(people, own.selectExpr("o_custkey AS contact_id", "o_custkey div 40 AS person_id").distinct())
