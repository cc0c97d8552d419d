"""Message stores: chats, messages, attachments, reactions, membership changes, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.functions import identity as fid
from tidemark.sources.base import contact_id, ledger_id, missing

CHANNEL = "imessage"


def _thread(adapter: str):
    return F.concat(F.lit(f"{adapter}:"), F.format_string("chat_id:%d", F.col("chat_id").cast("long")))


def _direction():
    return F.when(F.col("is_from_me").cast("boolean"), "sent").otherwise("received")


def messages(raw: DataFrame, chats: DataFrame, attachments: DataFrame, adapter: str = CHANNEL, since: int | None = None) -> DataFrame:
    """Message events strictly after `since`; what they hold follows from text and attachments."""
    if since is not None:
        raw = raw.where(F.col("timestamp") > since)
    n = attachments.groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("n_attachments"))
    rows = raw.join(n, "id", "left").join(chats.select(F.col("id").alias("chat_id"), "chat_identifier", "chat_name", "is_group"), "chat_id", "left")
    has_text, has_files = F.trim(F.coalesce("content", F.lit(""))) != "", F.coalesce("n_attachments", F.lit(0)) > 0
    types = F.when(has_text & has_files, F.array(F.lit("text"), F.lit("attachment"))).when(has_files, F.array(F.lit("attachment"))).otherwise(F.array(F.lit("text")))
    return rows.select(ledger_id(adapter, F.col("guid")).alias("event_id"), F.col("timestamp").cast("long").alias("ts"), F.lit(CHANNEL).alias("channel"), types.alias("content_types"), "content", _direction().alias("direction"), _thread(adapter).alias("thread_id"), F.when(missing(F.col("reply_to_guid")).isNotNull(), ledger_id(adapter, F.col("reply_to_guid"))).alias("reply_to"), F.lit(adapter).alias("source_adapter"), F.col("guid").alias("source_id"), "sender_id", "chat_identifier", "is_from_me", "is_group")


def reactions(raw: DataFrame, adapter: str = CHANNEL, since: int | None = None) -> DataFrame:
    if since is not None:
        raw = raw.where(F.col("timestamp") > since)
    return raw.select(ledger_id(adapter, F.col("guid")).alias("event_id"), F.col("timestamp").cast("long").alias("ts"), F.lit(CHANNEL).alias("channel"), F.array(F.lit("reaction")).alias("content_types"), codes.reaction(F.col("reaction_type")).alias("content"), _direction().alias("direction"), _thread(adapter).alias("thread_id"), ledger_id(adapter, F.col("original_message_guid")).alias("reply_to"), F.lit(adapter).alias("source_adapter"), F.col("guid").alias("source_id"), "sender_id", "is_from_me")


def membership(raw: DataFrame, adapter: str = CHANNEL, since: int | None = None) -> DataFrame:
    if since is not None:
        raw = raw.where(F.col("timestamp") > since)
    meta = F.to_json(F.struct(codes.group_action(F.col("action_type")).alias("action"), "item_type", "message_action_type", "group_title"))
    return raw.select(ledger_id(adapter, F.col("guid")).alias("event_id"), F.col("timestamp").cast("long").alias("ts"), F.lit(CHANNEL).alias("channel"), F.array(F.lit("membership")).alias("content_types"), F.col("group_title").alias("content"), _direction().alias("direction"), _thread(adapter).alias("thread_id"), F.lit(None).cast("string").alias("reply_to"), F.lit(adapter).alias("source_adapter"), F.col("guid").alias("source_id"), meta.alias("metadata_json"), F.col("actor_id").alias("sender_id"), "member_id", "is_from_me")


def attachments(raw: DataFrame, messages_raw: DataFrame, adapter: str = CHANNEL) -> DataFrame:
    owner = messages_raw.select(F.col("id").alias("message_id"), F.col("guid").alias("message_guid"))
    return raw.join(owner, "message_id").select(ledger_id(adapter, F.col("guid")).alias("attachment_id"), ledger_id(adapter, F.col("message_guid")).alias("event_id"), F.col("file_name").alias("filename"), "mime_type", codes.media_type(F.col("mime_type"), F.col("is_sticker")).alias("media_type"), F.col("size").cast("long").alias("size_bytes"), F.col("created_date").cast("long").alias("created_at"))


def threads(chats: DataFrame, adapter: str = CHANNEL) -> DataFrame:
    return chats.select(F.concat(F.lit(f"{adapter}:"), F.format_string("chat_id:%d", F.col("id").cast("long"))).alias("thread_id"), F.lit(CHANNEL).alias("channel"), F.coalesce(missing(F.col("chat_name")), F.col("chat_identifier")).alias("name"), F.lit(adapter).alias("source_adapter"), F.col("id").cast("string").alias("source_id"))


def sightings(contacts: DataFrame, adapter: str = CHANNEL) -> DataFrame:
    """Contacts (id, identifier, name) as sightings for the contact upsert."""
    kind = F.when(F.contains("identifier", F.lit("@")), "email").otherwise("phone")
    return contacts.select(F.col("id").alias("raw_id"), kind.alias("type"), F.col("identifier").alias("value"), F.col("name").alias("display_name"), F.lit(adapter).alias("source"), F.lit(0).cast("long").alias("ts"))


def participants(events: DataFrame, contact_of: DataFrame, me: str) -> DataFrame:
    """Senders and recipients. contact_of: (sender_id, contact_id). One's own messages go from `me`
    to the chat; received ones the other way."""
    named = events.join(contact_of, "sender_id", "left")
    sender = F.when(F.col("is_from_me").cast("boolean"), F.lit(me)).otherwise(F.col("contact_id"))
    sent = named.select("event_id", sender.alias("contact_id"), F.lit("sender").alias("role")).where("contact_id IS NOT NULL")
    got = named.where(~F.col("is_from_me").cast("boolean")).select("event_id", F.lit(me).alias("contact_id"), F.lit("recipient").alias("role"))
    out = sent.unionByName(got)
    if "chat_identifier" in events.columns:
        kind = F.when(F.contains("chat_identifier", F.lit("@")), "email").otherwise("phone")
        to = events.where(F.col("is_from_me").cast("boolean") & ~F.coalesce(F.col("is_group").cast("boolean"), F.lit(False)) & F.col("chat_identifier").isNotNull())
        out = out.unionByName(to.select("event_id", contact_id(kind, fid.identifier(F.col("chat_identifier"), kind)).alias("contact_id"), F.lit("recipient").alias("role")))
    if "member_id" in events.columns:
        members = events.select("event_id", F.col("member_id").alias("sender_id")).join(contact_of, "sender_id").select("event_id", "contact_id", F.lit("member").alias("role"))
        out = out.unionByName(members)
    return out.distinct()
