"""Mail: API messages (JSON), mailbox files, labels, address lists."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.runs import set_values
from tidemark.sources.base import contact_id, ledger_id

CHANNEL = "gmail"
PARTS = "array<struct<mimeType:string,filename:string,body:struct<data:string>,parts:array<struct<mimeType:string,filename:string,body:struct<data:string>>>>>"
MESSAGE = f"id string, threadId string, internalDate string, labelIds array<string>, snippet string, payload struct<mimeType:string,headers:array<struct<name:string,value:string>>,body:struct<data:string>,parts:{PARTS}>"


def header(name: str) -> Column:
    found = F.filter(F.col("payload.headers"), lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, F.lit(0))["value"]


@F.pandas_udf(T.StringType())
def decoded_header(values: pd.Series) -> pd.Series:
    """MIME encoded words as text."""
    return values.map(lambda v: None if v is None else _decode(v))


def _decode(value: str) -> str:
    try:
        return str(make_header(decode_header(value.strip())))
    except (LookupError, ValueError):
        return value.strip()


def addresses_of(text: str | None) -> list[dict]:
    """Addresses of a header in lower case, with names; broken lists are cut at commas."""
    text = (text or "").strip()
    parsed = email.utils.getaddresses([text], strict=True)
    good = [(n.strip(), a.strip().lower()) for n, a in parsed if "@" in a]
    if not good and text:
        for part in filter(None, map(str.strip, text.split(","))):
            m = re.match(r"(.*?)<([^>]+)>", part)
            good.append((m[1].strip(), m[2].strip().lower()) if m else ("", part.lower()))
    return [{"name": n, "email": a} for n, a in good]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])))
def addresses(values: pd.Series) -> pd.Series:
    return values.map(addresses_of)


def body_text() -> Column:
    """The first plain-text part, URL-safe base64, else the body, else the first HTML part."""
    decode = lambda data: F.decode(F.unbase64(F.translate(data, "-_", "+/")), "utf-8")
    nested = F.flatten(F.transform(F.coalesce("payload.parts", F.array().cast(PARTS)), lambda p: F.concat(F.array(F.struct(p["mimeType"].alias("mimeType"), p["body"]["data"].alias("data"))), F.coalesce(F.transform(p["parts"], lambda q: F.struct(q["mimeType"].alias("mimeType"), q["body"]["data"].alias("data"))), F.array().cast("array<struct<mimeType:string,data:string>>")))))
    pick = lambda kind: F.get(F.filter(nested, lambda p: (p["mimeType"] == kind) & p["data"].isNotNull()), F.lit(0))["data"]
    return F.coalesce(decode(pick("text/plain")), decode(F.col("payload.body.data")), decode(pick("text/html")))


def api_messages(raw: DataFrame, adapter: str = CHANNEL) -> DataFrame:
    """Events of API messages (see MESSAGE); SENT messages are sent, others received."""
    sent = F.array_contains(F.coalesce("labelIds", F.array().cast("array<string>")), "SENT")
    subject = F.coalesce(decoded_header(header("Subject")), F.lit(""))
    files = F.exists(F.coalesce("payload.parts", F.array().cast(PARTS)), lambda p: F.coalesce(p["filename"], F.lit("")) != "")
    content = F.when(subject != "", F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), F.coalesce(body_text(), F.lit("")))).otherwise(F.coalesce(body_text(), F.lit("")))
    return raw.select(ledger_id(adapter, F.col("id")).alias("event_id"), F.expr("cast(internalDate as bigint) div 1000").alias("ts"), F.lit(CHANNEL).alias("channel"), F.when(files, F.array(F.lit("text"), F.lit("attachment"))).otherwise(F.array(F.lit("text"))).alias("content_types"), content.alias("content"), F.when(sent, "sent").otherwise("received").alias("direction"), ledger_id(adapter, F.col("threadId")).alias("thread_id"), F.lit(None).cast("string").alias("reply_to"), F.lit(adapter).alias("source_adapter"), F.col("id").alias("source_id"), F.col("labelIds").alias("labels"), header("From").alias("from"), header("To").alias("to"), header("Cc").alias("cc"))


def read_api(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)


def participants(events: DataFrame) -> DataFrame:
    """(event_id, contact_id, role, email, name) of the From, To and Cc addresses."""
    out = None
    for column, role in (("from", "sender"), ("to", "recipient"), ("cc", "cc")):
        rows = events.select("event_id", F.explode(addresses(F.col(column))).alias("a")).select("event_id", contact_id("email", F.col("a.email")).alias("contact_id"), F.lit(role).alias("role"), "a.email", "a.name")
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["event_id", "contact_id", "role"])


def state(events: DataFrame) -> DataFrame:
    """(event_id, read_state, flagged, archived, status) from labels."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    has = lambda name: F.array_contains(labels, name)
    return events.select("event_id", F.when(F.size(labels) == 0, "unknown").when(has("UNREAD"), "unread").otherwise("read").alias("read_state"), (has("STARRED") | has("IMPORTANT")).alias("flagged"), (~has("INBOX")).alias("archived"), F.when(has("DRAFT"), "draft").when(F.col("direction").isin("sent", "received"), F.col("direction")).otherwise("unknown").alias("status"))


def tags(events: DataFrame, created_at: int) -> DataFrame:
    """One tag a label; an event's old label tags are to be replaced by these."""
    own = events.select("event_id", F.explode("labels").alias("label")).where(F.trim("label") != "")
    return own.select("event_id", F.lit("label").alias("tag_type"), F.concat(F.lit("gmail_label:"), F.trim("label")).alias("value"), F.lit(CHANNEL).alias("source"), F.lit(created_at).cast("long").alias("created_at")).distinct()


# --- change logs ---

_CHANGED = "array<struct<message:struct<id:string,threadId:string,labelIds:array<string>>,labelIds:array<string>>>"
HISTORY = f"id string, messagesAdded {_CHANGED}, messagesDeleted {_CHANGED}, labelsAdded {_CHANGED}, labelsRemoved {_CHANGED}"
HISTORY_STATE = "message_id string, label string, present boolean, history_id long"
HISTORY_KEY = "gmail_history_id"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Change records (see HISTORY) of JSON files, one a line."""
    return spark.read.schema(HISTORY).json(path)


def history_changes(raw: DataFrame) -> DataFrame:
    """Changes (see HISTORY_STATE) of records: a null label is the message itself, come or gone.

    A message that comes brings its labels. Records without id, and changes without message, are left out.
    """
    none = F.array().cast("array<string>")

    def changes(records: str, present: bool, labels) -> Column:
        each = F.coalesce(records, F.array().cast(_CHANGED))
        return F.flatten(F.transform(each, lambda c: F.transform(labels(c), lambda x: F.struct(c["message"]["id"].alias("message_id"), x.alias("label"), F.lit(present).alias("present")))))

    whole = F.array(F.lit(None).cast("string"))
    parts = [
        changes("messagesAdded", True, lambda c: F.concat(whole, F.coalesce(c["message"]["labelIds"], none))),
        changes("messagesDeleted", False, lambda c: whole),
        changes("labelsAdded", True, lambda c: F.coalesce(c["labelIds"], none)),
        changes("labelsRemoved", False, lambda c: F.coalesce(c["labelIds"], none)),
    ]
    out = raw.select(F.try_to_number("id", F.lit("9" * 19)).cast("long").alias("history_id"), F.explode(F.concat(*parts)).alias("c"))
    return out.select("c.message_id", "c.label", "c.present", "history_id").where("message_id IS NOT NULL AND history_id IS NOT NULL")


def fold_history(state_: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes, in whatever order and however often they come.

    One row a message and label: its change of the greatest history id; within one record a removal
    comes after an addition. So batches of changes may be folded in any order, and again.
    """
    names = ["message_id", "label", "present", "history_id"]
    last = F.max(F.struct("history_id", (~F.col("present")).alias("gone")))
    out = state_.select(*names).union(changes.select(*names)).groupBy("message_id", "label").agg(last.alias("last"))
    return out.select("message_id", "label", (~F.col("last.gone")).alias("present"), "last.history_id")


def history_labels(state_: DataFrame) -> DataFrame:
    """(message_id, deleted, labels, history_id) of a folded state.

    A message that has come (again) has no labels from before; one that is gone has none.
    """
    of_message = F.col("label").isNull()
    came = F.max(F.when(of_message & F.col("present"), F.col("history_id")))
    labels = F.collect_list(F.when(~of_message & F.col("present"), F.struct("label", "history_id")))
    out = state_.groupBy("message_id").agg(came.alias("came"), F.coalesce(F.max(of_message & ~F.col("present")), F.lit(False)).alias("deleted"), labels.alias("own"), F.max("history_id").alias("history_id"))
    kept = F.filter("own", lambda x: ~F.col("deleted") & (x["history_id"] >= F.coalesce("came", x["history_id"])))
    return out.select("message_id", "deleted", F.array_sort(F.transform(kept, lambda x: x["label"])).alias("labels"), "history_id")


def relabelled(events: DataFrame, folded: DataFrame, adapter: str = CHANNEL) -> DataFrame:
    """Events (with labels) after a change log: messages that are gone go, labels that it knows replace the old ones."""
    own = folded.select(ledger_id(adapter, F.col("message_id")).alias("event_id"), F.col("deleted").alias("__gone"), F.col("labels").alias("__labels"))
    out = events.join(own, "event_id", "left").where("NOT coalesce(__gone, false)")
    return out.withColumn("labels", F.coalesce("__labels", "labels")).select(*events.columns)


def history_watermark(values: DataFrame, changes: DataFrame, adapter: str, now: int) -> DataFrame:
    """Small state (adapter, key, value, updated_at) with the greatest history id; it never falls."""
    old = values.where((F.col("adapter") == adapter) & (F.col("key") == HISTORY_KEY)).select(F.col("value").cast("long").alias("history_id"))
    top = old.union(changes.select("history_id")).agg(F.max("history_id").alias("top")).where("top > 0")
    return set_values(values, top.select(F.lit(adapter).alias("adapter"), F.lit(HISTORY_KEY).alias("key"), F.col("top").cast("string").alias("value"), F.lit(now).cast("long").alias("updated_at")))


def backfill_months(first: str, now: str, recent: int = 3) -> list[tuple[str, str]]:
    """(from, to) dates of months, the `recent` latest first, then from the oldest on."""
    y, m = map(int, first.split("-")[:2])
    out = []
    while (y, m) <= tuple(map(int, now.split("-")[:2])):
        ny, nm = y + m // 12, m % 12 + 1
        out.append((f"{y:04d}-{m:02d}-01", f"{ny:04d}-{nm:02d}-01"))
        y, m = ny, nm
    return out[-recent:][::-1] + out[:-recent]


# --- mailbox files ---

MBOX = "message_id string, thread_id string, ts long, subject string, body string, labels array<string>, `from` string, `to` string, cc string, has_attachments boolean, truncated boolean"


def labels_of(value: str | None) -> list[str]:
    words = re.split(r"[,\s]+", (value or "").strip().removeprefix("(").removesuffix(")").replace('"', ""))
    return list(dict.fromkeys(w for w in (x.removeprefix("\\").strip() for x in words) if w))


def parse_message(raw: str, most_bytes: int) -> tuple | None:
    """A mailbox message as a row of MBOX; None without a usable date and id."""
    body = raw.encode("utf-8", "surrogateescape")
    cut = len(body) > most_bytes
    # Bytes, so that parts of eight bits keep their own character set.
    m = email.message_from_bytes(body[:most_bytes], policy=email.policy.compat32)
    heads: dict[str, str] = {}
    for name, value in m.raw_items():  # as they stand; bytes beyond ASCII are taken for UTF-8
        heads.setdefault(name.lower(), value.encode("utf-8", "surrogateescape").decode("utf-8", "replace"))
    try:
        ts = int(email.utils.parsedate_to_datetime(heads["date"]).timestamp())
    except (KeyError, TypeError, ValueError):
        return None
    own = (heads.get("x-gm-msgid") or heads.get("message-id") or "").strip()
    if not own:
        return None
    text, files = "", False
    for part in m.walk():
        if part.get_filename():
            files = True
        elif part.get_content_type() == "text/plain" and not text:
            text = _plain(part)
    return own, (heads.get("x-gm-thrid") or own).strip(), ts, _decode(heads.get("subject") or ""), text, labels_of(_decode(heads.get("x-gm-labels") or "")), heads.get("from"), heads.get("to"), heads.get("cc"), files, cut


def _plain(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace").strip()
    except LookupError:  # a character set that nobody knows
        return data.decode("utf-8", "replace").strip()


def read_mbox(spark: SparkSession, path: str, most_bytes: int = 4 << 20) -> DataFrame:
    """Messages of mailbox files. The record separator is a line that begins with `From `, so a
    file is split at many places and large mailboxes are read in parallel."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                # The first line is what is left of the separator line.
                head, _, rest = value.removeprefix("From ").partition("\n")
                row = parse_message(re.sub(r"(?m)^>(>*From )", r"\1", rest.replace("\r\n", "\n")), most_bytes) if head or rest else None
                if row:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=["message_id", "thread_id", "ts", "subject", "body", "labels", "from", "to", "cc", "has_attachments", "truncated"])

    return lines.mapInPandas(run, MBOX)


def mbox_events(messages: DataFrame, account: str, adapter: str = CHANNEL) -> DataFrame:
    """Ledger events of mailbox messages; those that the account sent, or labelled so, are sent."""
    sender = F.get(addresses(F.col("from")), F.lit(0))["email"]
    upper = F.transform("labels", F.upper)
    sent = F.array_contains(upper, "SENT") | (sender == account.lower())
    content = F.when(F.col("subject") != "", F.concat(F.lit("Subject: "), "subject", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    out = messages.select(ledger_id(adapter, F.col("message_id")).alias("event_id"), "ts", F.lit(CHANNEL).alias("channel"), F.when(F.col("has_attachments"), F.array(F.lit("text"), F.lit("attachment"))).otherwise(F.array(F.lit("text"))).alias("content_types"), content.alias("content"), F.when(F.coalesce(sent, F.lit(False)), "sent").otherwise("received").alias("direction"), ledger_id(adapter, F.col("thread_id")).alias("thread_id"), F.lit(None).cast("string").alias("reply_to"), F.lit(adapter).alias("source_adapter"), F.col("message_id").alias("source_id"), upper.alias("labels"), "from", "to", "cc")
    return out.dropDuplicates(["source_adapter", "source_id"])
