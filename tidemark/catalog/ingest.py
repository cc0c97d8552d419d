"""Sources: raw rows of each kind, made from the test tables, as ledger rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.base import ledger, query, seconds, table
from tidemark.functions import text as tx
from tidemark.operators import facets
from tidemark.plans.components import shared_folder
from tidemark.sources import files, mail, messages, people, sessions
from tidemark.sources.base import apply

_EPOCH = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"

# --- message stores ---

_RAW = "event_id AS id, 'g' || event_id AS guid, user_id % 40 AS chat_id, user_id AS sender_id, CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN NULL ELSE props END AS content, event_id % 2 AS is_from_me, CASE WHEN event_id % 5 = 0 THEN 'g' || (event_id + 1) WHEN event_id % 3 = 0 THEN '' END AS reply_to_guid"
_CHATS = "chat_id AS id, CASE WHEN chat_id % 2 = 0 THEN '+1 (555) 100-' || (1000 + chat_id) ELSE 'U' || chat_id || '@X.example' END AS chat_identifier, CASE WHEN chat_id % 3 = 0 THEN '' ELSE 'Chat ' || chat_id END AS chat_name, CASE WHEN chat_id % 4 = 0 THEN 1 ELSE 0 END AS is_group"
_STORE = f"raw AS (SELECT {_RAW}, {_EPOCH} AS timestamp FROM events), chats AS (SELECT {_CHATS} FROM (SELECT DISTINCT user_id % 40 AS chat_id FROM events)), files AS (SELECT event_id AS message_id FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 12 = 0), n AS (SELECT message_id, COUNT(*) AS n FROM files GROUP BY message_id)"


def _store(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = events.withColumn("timestamp", seconds("ts")).selectExpr(*_split(_RAW), "timestamp")
    chats = events.selectExpr("user_id % 40 AS chat_id").distinct().selectExpr(*_split(_CHATS))
    held = events.where("event_id % 6 = 0").union(events.where("event_id % 12 = 0")).selectExpr("event_id AS message_id")
    return raw, chats, held


def _split(columns: str) -> list[str]:
    """Expressions between commas outside of brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[begin:i])
            begin = i + 1
    return out


@query(f"WITH {_STORE} SELECT 'imessage:' || guid AS event_id, timestamp AS ts, CASE WHEN n.n > 0 AND trim(COALESCE(content, '')) != '' THEN 'text,attachment' WHEN n.n > 0 THEN 'attachment' ELSE 'text' END AS content_types, content, CASE WHEN is_from_me = 1 THEN 'sent' ELSE 'received' END AS direction, 'imessage:chat_id:' || raw.chat_id AS thread_id, CASE WHEN reply_to_guid != '' THEN 'imessage:' || reply_to_guid END AS reply_to, chat_identifier FROM raw LEFT JOIN n ON n.message_id = raw.id LEFT JOIN chats ON chats.id = raw.chat_id WHERE timestamp > 1704200000")
def message_events(spark, sf_dir):
    out = messages.messages(*_store(spark, sf_dir), since=1704200000)
    return out.select("event_id", "ts", F.array_join("content_types", ",").alias("content_types"), "content", "direction", "thread_id", "reply_to", "chat_identifier")


@query(f"WITH {_STORE}, named AS (SELECT 'imessage:' || guid AS event_id, is_from_me, is_group, chat_identifier, CASE WHEN is_from_me = 1 THEN 'me' WHEN sender_id % 7 > 0 THEN 'c' || sender_id END AS sender FROM raw JOIN chats ON chats.id = raw.chat_id) SELECT event_id, sender AS contact_id, 'sender' AS role FROM named WHERE sender IS NOT NULL UNION ALL SELECT event_id, 'me', 'recipient' FROM named WHERE is_from_me = 0 UNION ALL SELECT event_id, sha256(CASE WHEN contains(chat_identifier, '@') THEN 'email|' || lower(chat_identifier) ELSE 'phone|' || substr(regexp_replace(chat_identifier, '[^0-9]', '', 'g'), 2) END), 'recipient' FROM named WHERE is_from_me = 1 AND is_group = 0")
def message_participants(spark, sf_dir):
    events = messages.messages(*_store(spark, sf_dir))
    known = table(spark, sf_dir, "events").where("user_id % 7 > 0").selectExpr("user_id AS sender_id", "'c' || user_id AS contact_id").distinct()
    return messages.participants(events, known, "me")


_CODE = "CASE 2000 + event_id % 8 WHEN 2000 THEN '❤️' WHEN 2001 THEN '👍' WHEN 2002 THEN '👎' WHEN 2003 THEN '😂' WHEN 2004 THEN '‼️' WHEN 2005 THEN '❓' ELSE 'reaction:' || (2000 + event_id % 8) END"
_ACTION = "CASE event_id % 4 WHEN 1 THEN 'added' WHEN 3 THEN 'removed' ELSE 'unknown' END"


@query(f"SELECT 'imessage:r' || event_id AS event_id, {_EPOCH} AS ts, 'reaction' AS kind, {_CODE} AS content, 'imessage:g' || user_id AS reply_to, NULL AS action, 'imessage:chat_id:' || (user_id % 40) AS thread_id FROM events UNION ALL SELECT 'imessage:m' || event_id, {_EPOCH}, 'membership', 'Group ' || (user_id % 40), NULL, {_ACTION}, 'imessage:chat_id:' || (user_id % 40) FROM events")
def message_reactions_and_members(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("timestamp", seconds("ts")).selectExpr("timestamp", "'r' || event_id AS guid", "2000 + event_id % 8 AS reaction_type", "event_id % 2 AS is_from_me", "user_id % 40 AS chat_id", "'g' || user_id AS original_message_guid", "user_id AS sender_id", "event_id % 4 AS action_type", "1 AS item_type", "0 AS message_action_type", "'Group ' || (user_id % 40) AS group_title", "user_id AS actor_id", "user_id AS member_id")
    kind = F.get("content_types", F.lit(0)).alias("kind")
    reacted = messages.reactions(raw).select("event_id", "ts", kind, "content", "reply_to", F.lit(None).cast("string").alias("action"), "thread_id")
    members = messages.membership(raw.withColumn("guid", F.concat(F.lit("m"), F.substring("guid", 2, 20))))
    return reacted.union(members.select("event_id", "ts", kind, "content", "reply_to", F.get_json_object("metadata_json", "$.action"), "thread_id"))


@query(f"WITH {_STORE} SELECT 'imessage:a' || f.message_id || '-' || f.k AS id, 'imessage:g' || f.message_id AS event_id, 'f.png' AS name, 'image' AS media_type, CAST(f.message_id * 10 AS BIGINT) AS size_bytes FROM (SELECT event_id AS message_id, 0 AS k FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 12 = 0) f UNION ALL SELECT 'imessage:chat_id:' || id, NULL, CASE WHEN chat_name = '' THEN chat_identifier ELSE chat_name END, 'thread', NULL FROM chats")
def message_files_and_threads(spark, sf_dir):
    raw, chats, _ = _store(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    held = events.where("event_id % 6 = 0").selectExpr("event_id", "0 AS k").union(events.where("event_id % 12 = 0").selectExpr("event_id", "1 AS k")).selectExpr("event_id AS message_id", "'a' || event_id || '-' || k AS guid", "'f.png' AS file_name", "'image/png' AS mime_type", "0 AS is_sticker", "event_id * 10 AS size", "0L AS created_date")
    own = messages.attachments(held, raw).selectExpr("attachment_id AS id", "event_id", "filename AS name", "media_type", "size_bytes")
    return own.union(messages.threads(chats).selectExpr("thread_id AS id", "cast(null as string)", "name", "'thread'", "cast(null as bigint)"))


# --- mail ---


def _mails(spark, sf_dir):
    """API messages: plain-text parts, bodies alone, or HTML and a file; encoded subjects."""
    data = "translate(base64(encode(text, 'utf-8')), '+/', '-_')"
    none = "cast(null as array<struct<mimeType:string,filename:string,body:struct<data:string>>>)"
    part = lambda kind, name, body: f"named_struct('mimeType', '{kind}', 'filename', '{name}', 'body', named_struct('data', {body}), 'parts', {none})"
    inner = f"named_struct('mimeType', 'multipart/alternative', 'filename', '', 'body', named_struct('data', cast(null as string)), 'parts', array(named_struct('mimeType', 'text/plain', 'filename', '', 'body', named_struct('data', {data}))))"
    parts = f"CASE turn % 3 WHEN 0 THEN array({part('text/html', '', 'base64(encode(role, \"utf-8\"))')}, {inner}) WHEN 2 THEN array({part('text/html', '', data)}, {part('image/png', 'p.png', 'cast(null as string)')}) END"
    header = lambda n, v: f"named_struct('name', '{n}', 'value', {v})"
    heads = ", ".join([header("subject", "CASE WHEN turn % 4 < 3 THEN '=?utf-8?q?Caf=C3=A9?= ' || conv_id ELSE '' END"), header("From", "'Name ' || conv_id || ' <U' || conv_id || '@X.Example>'"), header("To", "'a' || turn || '@x.example, \"Bell, C\" <B@y.example>'"), header("Cc", "CASE WHEN turn % 2 = 0 THEN 'cc@z.example, broken <, a@b.example' END")])
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id * 1000 + turn as string) AS id", "'t' || conv_id AS threadId", "cast(conv_id * 60000 + turn * 1000 + 7 as string) AS internalDate", "CASE WHEN role = 'user' THEN array('SENT', ' ') ELSE array('INBOX', 'UNREAD', 'INBOX') END AS labelIds", "'' AS snippet", f"named_struct('mimeType', 'x', 'headers', array({heads}), 'body', named_struct('data', CASE WHEN turn % 3 = 1 THEN {data} END), 'parts', {parts}) AS payload")


@query("SELECT 'gmail:' || (conv_id * 1000 + turn) AS event_id, CAST(conv_id * 60 + turn AS BIGINT) AS ts, CASE WHEN turn % 3 = 2 THEN 'text,attachment' ELSE 'text' END AS content_types, CASE WHEN turn % 4 < 3 THEN 'Subject: Café ' || conv_id || chr(10) || chr(10) || text ELSE text END AS content, CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END AS direction, 'gmail:t' || conv_id AS thread_id FROM conversations")
def mail_events(spark, sf_dir):
    out = mail.api_messages(_mails(spark, sf_dir))
    return out.select("event_id", "ts", F.array_join("content_types", ",").alias("content_types"), "content", "direction", "thread_id")


@query("WITH m AS (SELECT 'gmail:' || (conv_id * 1000 + turn) AS event_id, conv_id, turn FROM conversations), a AS (SELECT event_id, 'sender' AS role, 'u' || conv_id || '@x.example' AS email, 'Name ' || conv_id AS name FROM m UNION ALL SELECT event_id, 'recipient', 'a' || turn || '@x.example', '' FROM m UNION ALL SELECT event_id, 'recipient', 'b@y.example', 'Bell, C' FROM m) SELECT event_id, sha256('email|' || email) AS contact_id, role, email, name FROM a")
def mail_participants(spark, sf_dir):
    return mail.participants(mail.api_messages(_mails(spark, sf_dir))).where("role != 'cc'")


@query("SELECT 'gmail:' || (conv_id * 1000 + turn) AS event_id, 'gmail_label:' || l AS value FROM conversations, unnest(CASE WHEN role = 'user' THEN ['SENT'] ELSE ['INBOX', 'UNREAD'] END) t(l)")
def mail_tags(spark, sf_dir):
    return mail.tags(mail.api_messages(_mails(spark, sf_dir)), 7).select("event_id", "value")


def _written(df, name: str, spark) -> str:
    """Lines as files of the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


@query("SELECT 'gmail:' || (conv_id * 1000 + turn) AS event_id, CAST(1704067200 + turn * 60 + conv_id % 50 AS BIGINT) AS ts, 'Subject: Café ' || conv_id || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content, CASE WHEN role = 'user' OR conv_id % 3 = 0 THEN 'sent' ELSE 'received' END AS direction, 'gmail:T' || conv_id AS thread_id, CASE WHEN role = 'user' THEN 'SENT,ÉTÉ' ELSE 'INBOX' END AS labels FROM conversations")
def mbox_events(spark, sf_dir):
    """Mailbox files, a third of them of the account's own address; each message is in them twice."""
    own = "concat('From x@y Mon Jan  1 00:00:00 2024\nMessage-ID: <x', conv_id, '.', turn, '>\nX-GM-MSGID: ', conv_id * 1000 + turn, '\nX-GM-THRID: T', conv_id, '\nX-GM-LABELS: ', CASE WHEN role = 'user' THEN '(\\\\Sent \"Été\")' ELSE 'Inbox' END, '\nDate: Mon, 01 Jan 2024 ', lpad(turn div 60, 2, '0'), ':', lpad(turn % 60, 2, '0'), ':', lpad(conv_id % 50, 2, '0'), ' +0000\nFrom: ', CASE WHEN conv_id % 3 = 0 THEN 'Me <ME@x.example>' ELSE 'you@x.example' END, '\nSubject: =?utf-8?q?Caf=C3=A9?= ', conv_id, '\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n', regexp_replace(text, '(?m)^(>*From )', '>$1'), '\n')"
    rows = table(spark, sf_dir, "conversations").selectExpr(own)
    read = mail.read_mbox(spark, _written(rows.union(rows), "mbox", spark))
    return mail.mbox_events(read, "me@x.example").select("event_id", "ts", "content", "direction", "thread_id", F.array_join("labels", ",").alias("labels"))


_KIND = "CASE WHEN event_type = 'signup' THEN 'messagesAdded' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'messagesDeleted' WHEN event_type IN ('click', 'error') THEN 'labelsAdded' ELSE 'labelsRemoved' END"
_CHANGE = f"'m' || CAST(user_id % 50 AS {{s}}) || '.' || CAST(event_id % 20 AS {{s}}) AS message_id, 1 + event_id * 7919 % 40009 AS history_id, {_KIND} AS kind, 'L' || CAST(event_id % 7 AS {{s}}) AS one, 'L' || CAST(event_id % 3 AS {{s}}) AS two"


@query(f"""WITH c AS (SELECT {_CHANGE.format(s="VARCHAR")} FROM events),
each AS (SELECT message_id, history_id, NULL AS label, kind = 'messagesAdded' AS present FROM c WHERE kind IN ('messagesAdded', 'messagesDeleted') UNION ALL SELECT message_id, history_id, unnest([one, two]), kind != 'labelsRemoved' FROM c WHERE kind != 'messagesDeleted'),
last AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY message_id, label ORDER BY history_id DESC, present) = 1),
own AS (SELECT *, MAX(CASE WHEN label IS NULL THEN history_id END) OVER (PARTITION BY message_id) AS came, COALESCE(MAX(CASE WHEN label IS NULL THEN CAST(present AS INTEGER) END) OVER (PARTITION BY message_id), 1) AS here FROM last)
SELECT message_id, here = 0 AS deleted, COALESCE(string_agg(label, ',' ORDER BY label) FILTER (WHERE here = 1 AND label IS NOT NULL AND present AND history_id >= COALESCE(came, 0)), '') AS labels, MAX(history_id) AS history_id FROM own GROUP BY message_id, here""")
def mail_history(spark, sf_dir):
    """A change log read from files in two batches, the later changes first, a third of them twice."""
    c = table(spark, sf_dir, "events").selectExpr(*_split(_CHANGE.format(s="STRING")))
    change = "array(named_struct('message', named_struct('id', message_id, 'threadId', message_id, 'labelIds', array(one, two)), 'labelIds', array(one, two)))"
    kinds = ("messagesAdded", "messagesDeleted", "labelsAdded", "labelsRemoved")
    rows = c.selectExpr("cast(history_id as string) AS id", *[f"CASE WHEN kind = '{k}' THEN {change} END AS {k}" for k in kinds], "history_id")
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    late = F.col("history_id") > 20000
    rows.union(rows.where("history_id % 3 = 0")).where(late).drop("history_id").write.json(f"{folder}/1")
    rows.union(rows.where("history_id % 3 = 0")).where(~late).drop("history_id").write.json(f"{folder}/2")
    state = spark.createDataFrame([], mail.HISTORY_STATE)
    for batch in (1, 2, 1):
        state = mail.fold_history(state, mail.history_changes(mail.read_history(spark, f"{folder}/{batch}")))
    return mail.history_labels(state).select("message_id", "deleted", F.array_join("labels", ",").alias("labels"), "history_id")


# --- calendars, address books, posts, logs ---


def _calendar(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) AS id", "o_orderstatus AS summary", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS description", "CASE WHEN o_orderkey % 2 = 0 THEN 'Room ' || o_custkey END AS location", "CASE WHEN o_orderkey % 5 > 0 THEN 'confirmed' END AS status", "CASE WHEN o_orderkey % 3 = 0 THEN named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'), 'dateTime', cast(null as string)) WHEN o_orderkey % 3 = 1 THEN named_struct('date', cast(null as string), 'dateTime', date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:30:00+02:00') ELSE named_struct('date', cast(null as string), 'dateTime', cast(null as string)) END AS start", "named_struct('email', ' C' || o_custkey || '@X.example', 'displayName', 'C') AS organizer", "array(named_struct('email', 'a' || (o_custkey % 7) || '@x.example', 'displayName', 'A', 'responseStatus', 'accepted'), named_struct('email', '', 'displayName', 'none', 'responseStatus', '')) AS attendees")


@query("SELECT 'calendar:primary:' || o_orderkey AS event_id, CAST(epoch(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 3 = 1 THEN 30600 ELSE 0 END AS ts, concat_ws(chr(10) || chr(10), o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'Room ' || o_custkey END, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END) AS content, CASE WHEN o_orderkey % 5 > 0 THEN 'confirmed' ELSE 'unknown' END AS status FROM orders WHERE o_orderkey % 3 < 2")
def calendar_events(spark, sf_dir):
    events = people.calendar_events(_calendar(spark, sf_dir))
    return events.select("event_id", "ts", "content").join(people.calendar_state(events).select("event_id", "status"), "event_id")


@query("WITH e AS (SELECT 'calendar:primary:' || o_orderkey AS event_id, o_custkey FROM orders WHERE o_orderkey % 3 < 2), a AS (SELECT event_id, 'organizer' AS role, 'c' || o_custkey || '@x.example' AS email FROM e UNION ALL SELECT event_id, 'attendee', 'a' || (o_custkey % 7) || '@x.example' FROM e) SELECT event_id, sha256('email|' || email) AS contact_id, role, email FROM a")
def calendar_participants(spark, sf_dir):
    return people.calendar_participants(people.calendar_events(_calendar(spark, sf_dir))).select("event_id", "contact_id", "role", "email")


def _book(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("'people/' || c_custkey AS resourceName", "array(named_struct('displayName', c_name)) AS names", "CASE WHEN c_custkey % 3 > 0 THEN array(named_struct('value', c_name || '@X.example'), named_struct('value', c_name || '@X.example'), named_struct('value', '')) END AS emailAddresses", "CASE WHEN c_custkey % 2 = 0 THEN array(named_struct('value', '+1 555 ' || (1000000 + c_custkey))) END AS phoneNumbers")


@query("SELECT 'people/' || c_custkey AS raw_id, 'email' AS type, c_name || '@X.example' AS value, c_name AS display_name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'people/' || c_custkey, 'phone', '+1 555 ' || (1000000 + c_custkey), c_name FROM customer WHERE c_custkey % 2 = 0")
def address_book(spark, sf_dir):
    return people.address_book(_book(spark, sf_dir)).select("raw_id", "type", "value", "display_name")


@query("SELECT 'people/' || c_custkey AS raw_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 'p' || c_custkey ELSE sha256('person|people/' || c_custkey) END AS person_id, NOT (c_custkey % 2 = 0 AND c_custkey % 5 = 0) AS is_new FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def address_book_persons(spark, sf_dir):
    own = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    known = own.selectExpr("'phone' AS type", "'555' || (1000000 + c_custkey) AS normalized", "c_custkey AS contact_id")
    return people.link_address_book(people.address_book(_book(spark, sf_dir)), known, own.selectExpr("c_custkey AS contact_id", "'p' || c_custkey AS person_id"))


@query(f"SELECT 'x:likes:' || event_id AS event_id, {_EPOCH} AS ts, props AS content, CASE WHEN event_id % 2 = 0 THEN 'x:c' || user_id END AS thread_id, CASE WHEN event_id % 3 = 0 THEN 'x:likes:' || user_id END AS reply_to, sha256('handle|@user' || user_id) AS contact_id FROM events")
def posts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS id", "props AS text", "date_format(ts, \"'Wed' MMM dd HH:mm:ss '+0000' yyyy\") AS createdAt", "CASE WHEN event_id % 2 = 0 THEN 'c' || user_id END AS conversationId", "CASE WHEN event_id % 3 = 0 THEN cast(user_id as string) END AS inReplyToStatusId", "named_struct('username', 'User' || user_id, 'name', 'N') AS author")
    return people.posts(rows.union(rows), "likes").select("event_id", "ts", "content", "thread_id", "reply_to", "contact_id")


@query(f"SELECT 'event_log:e' || event_id AS event_id, {_EPOCH} AS ts, CASE WHEN event_id % 3 = 0 THEN 'agent' ELSE 'terminal' END AS channel, event_type AS content_type, props AS content, CASE WHEN event_id % 2 = 0 THEN 'event_log:s' || user_id END AS thread_id FROM events")
def log_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("sec", seconds("ts")).selectExpr("'e' || event_id AS id", "CASE WHEN event_id % 2 = 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END AS ts", "CASE WHEN event_id % 2 = 0 THEN sec * 1000 + 999 END AS timestamp_ms", "CASE WHEN event_id % 3 = 0 THEN 'My-Agent' WHEN event_id % 3 = 1 THEN 'zsh' END AS source", "event_type AS type", "CASE WHEN event_id % 2 = 0 THEN 's' || user_id END AS session_id", "CASE WHEN event_id % 4 > 0 THEN props END AS content", "props AS payload")
    more = rows.limit(3).selectExpr("cast(null as string) AS id", "ts", "timestamp_ms", "source", "type", "session_id", "content", "payload")
    return files.log_events(rows.union(rows).union(more)).select("event_id", "ts", "channel", F.get("content_types", F.lit(0)).alias("content_type"), "content", "thread_id")


# --- AI sessions ---


@query(f"SELECT 'ai:' || event_id || ':tool' AS event_id, {_EPOCH} AS ts, CASE WHEN event_id % 3 = 0 THEN 'ls ' || user_id ELSE 'pwd' END AS content, 'ai:s' || user_id AS thread_id, 'c' || event_id AS tool_call_id FROM events WHERE event_id % 5 IN (0, 1) AND event_id % 7 NOT IN (1, 2) AND event_id % 11 > 0")
def session_commands(spark, sf_dir):
    data = "named_struct('name', element_at(array('run_terminal_cmd', ' run_terminal_command_v2', 'read_file', 'edit', cast(null as string)), cast(event_id % 5 as int) + 1), 'status', element_at(array('completed', 'cancelled', ' Pending', '', 'error', 'Completed', ''), cast(event_id % 7 as int) + 1), 'toolCallId', 'c' || event_id, 'params', CASE WHEN event_id % 3 = 0 THEN to_json(named_struct('command', ' ls ' || user_id || ' ')) END, 'rawArgs', to_json(named_struct('command', 'pwd')), 'additionalData', named_struct('status', CASE WHEN event_id % 11 = 0 THEN 'Running' END))"
    rows = table(spark, sf_dir, "events").withColumn("sec", seconds("ts")).selectExpr("cast(event_id as string) AS id", "'s' || user_id AS session_id", "sec * 1000 + 1 AS timestamp", f"to_json(named_struct('toolFormerData', {data})) AS metadata_json")
    return sessions.tool_commands(rows, "ai").select("event_id", "ts", "content", "thread_id", "tool_call_id")


@query("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, 's' || conv_id AS session_id, CASE WHEN turn % 3 = 1 THEN 'old' ELSE role END AS role, CASE WHEN turn % 2 = 0 AND turn % 3 = 1 THEN NULL ELSE text END AS content, CAST(turn AS INTEGER) AS sequence FROM conversations WHERE turn % 3 = 1 OR turn % 2 = 1 OR turn % 2 = 0")
def session_tables(spark, sf_dir):
    """Full-fidelity messages upserted by id: later rows win only where they say something."""
    rows = table(spark, sf_dir, "conversations")
    empty = spark.createDataFrame([], "id string")
    full = lambda df: sessions.full_fidelity(empty, df, empty, empty)["messages"]
    old = full(rows.where("turn % 3 = 1").selectExpr("conv_id * 1000 + turn AS id", "'s' || conv_id AS session_id", "'old' AS role", "cast(null as string) AS content", "turn AS sequence"))
    new = full(rows.selectExpr("conv_id * 1000 + turn AS id", "'s' || conv_id AS session_id", "CASE WHEN turn % 3 = 1 THEN NULL ELSE role END AS role", "CASE WHEN turn % 2 = 0 AND turn % 3 = 1 THEN NULL ELSE text END AS content", "turn AS sequence"))
    return apply({"messages": old}, {"messages": new})["messages"].select("id", "session_id", "role", "content", "sequence")


@query("SELECT event_id, 'Hi ' || user_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'end' ELSE '' END AS answer FROM events")
def visible_answers(spark, sf_dir):
    text = "'  <thinking>a' || event_id || '\nb</thinking>Hi ' || user_id || '<x_calls>f(1)</x_calls> y <x_results>9</x_results>' || CASE WHEN event_id % 2 = 0 THEN '\n\n\n<b>q</b>\n\n\nend\n' ELSE '<note k=1>z</note> ' END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS t").select("event_id", tx.strip_tool_and_thinking(F.col("t")).alias("answer"))


@query("SELECT event_id, 'file_reference' AS facet_type, 'f' || user_id AS value, NULL AS metadata_json FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'tool_invocation', event_type, '{\"call_id\":\"\",\"status\":\"done\"}' FROM events WHERE event_id % 3 > 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'mode', 'agentic', NULL FROM events WHERE event_id % 3 > 0 AND event_id % 5 = 0 UNION ALL SELECT event_id, 'capability', 'a', '{\"count\":2}' FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'capability', 'b', '{\"count\":1}' FROM events WHERE event_id % 3 > 0")
def session_facets(spark, sf_dir):
    meta = "to_json(named_struct('relevantFiles', array('f' || user_id, ''), 'toolFormerData', named_struct('name', CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END, 'status', 'done'), 'isAgentic', event_id % 5 = 0, 'capabilitiesRan', map('a', array(1, 2), 'c', array()), 'capabilityStatuses', map('a', array(1), 'b', array(5))))"
    events = table(spark, sf_dir, "events")
    return facets.session_facets(events.selectExpr("event_id", f"{meta} AS metadata_json"), done=events.where("event_id % 3 = 0").select("event_id"))


@query("SELECT 'ai:s' || conv_id AS thread_id, CASE conv_id % 3 WHEN 0 THEN 'Summary ' || conv_id WHEN 1 THEN 'Task' ELSE 'proj' END AS name, CASE WHEN conv_id % 2 = 0 THEN 'ai:s' || (conv_id + 1) END AS parent_thread_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def session_threads(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return sessions.threads(own.selectExpr("'s' || conv_id AS id", "CASE WHEN conv_id % 3 = 0 THEN ' Summary ' || conv_id ELSE ' ' END AS summary", "CASE WHEN conv_id % 3 = 1 THEN 'Task' ELSE '' END AS task_description", "'proj' AS project", "CASE WHEN conv_id % 2 = 0 THEN 's' || (conv_id + 1) ELSE '' END AS parent_session_id"), "ai").select("thread_id", "name", "parent_thread_id")


@query("SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, CAST(conv_id * 1000 AS VARCHAR) AS root_id, CAST(turn AS INTEGER) AS depth FROM conversations")
def session_turn_tree(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id * 1000 + turn as string) AS id", "CASE WHEN turn > 0 THEN cast(conv_id * 1000 + turn - 1 as string) ELSE 'gone' END AS parent_turn_id")
    return sessions.turn_depths(own)


# --- small state ---


@query(f"WITH s AS (SELECT event_type AS adapter, 'k' || (user_id % 20) AS key, MAX(event_id) AS v FROM events GROUP BY ALL) SELECT adapter, key, CASE WHEN adapter = 'click' THEN 'old' ELSE CAST(v AS VARCHAR) END AS value FROM s UNION ALL SELECT 'x', 'k', 'old'")
def adapter_values(spark, sf_dir):
    from tidemark.operators import runs

    new = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("adapter"), F.expr("'k' || (user_id % 20)").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    old = new.withColumn("value", F.lit("old")).union(spark.createDataFrame([("x", "k", "old")], new.schema))
    return runs.set_values(old, new.where("adapter != 'click'"))


@query(f"SELECT 1000 + ROW_NUMBER() OVER (ORDER BY {_EPOCH}, event_type, CAST(event_id AS VARCHAR)) AS seq, event_type AS type, CAST(event_id AS VARCHAR) AS event_id FROM events QUALIFY seq > 1500 AND seq <= 1600")
def bus_after(spark, sf_dir):
    from tidemark.operators import runs

    bus = spark.createDataFrame([(1000, "t", "a", "0", None, 1)], "seq long, type string, adapter string, event_id string, payload_json string, created_at long")
    rows = ledger(spark, sf_dir).selectExpr("channel AS type", "'a' AS adapter", "cast(event_id as string) AS event_id", "cast(null as string) AS payload_json", "ts AS created_at")
    return runs.after_seq(runs.emit(bus, rows), 1500).select("seq", "type", "event_id")


@query(f"SELECT event_type AS adapter, arg_max(event_id, ({_EPOCH}, event_id)) AS last_id, MAX({_EPOCH}) AS last_ts FROM events WHERE event_type = 'click' GROUP BY event_type UNION ALL SELECT 'view', 5, 5")
def advanced_watermarks(spark, sf_dir):
    from tidemark.operators import runs

    state = spark.createDataFrame([("click", 1, 1), ("view", 5, 5)], "adapter string, last_ts long, last_id long")
    batch = ledger(spark, sf_dir).selectExpr("event_id AS id", "ts", "channel")
    state = runs.advance_watermark(state, batch.where("channel = 'click'"), "click")
    return runs.advance_watermark(state, batch.where("channel = 'none'"), "view").select("adapter", "last_ts", "last_id")


@query("SELECT 'doc:' || doc_id AS doc_key, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS retrieval_count, CAST(CASE WHEN doc_id % 3 = 0 THEN 77 WHEN doc_id % 2 = 0 THEN 50 END AS BIGINT) AS last_retrieved_at FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def tracked_retrievals(spark, sf_dir):
    from tidemark.operators.documents import track_retrieval

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "'doc:' || doc_id AS doc_key")
    state = docs.where("doc_id % 2 = 0").selectExpr("doc_key", "3L AS retrieval_count", "50L AS last_retrieved_at")
    hits = docs.where("doc_id % 3 = 0").selectExpr("doc_key", "1.0D AS score")
    return track_retrieval(state, hits, "q", 77)[0]


