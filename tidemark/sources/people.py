"""Calendars, address books and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.base import contact_id, ledger_id
from tidemark.functions import identity as fid

CALENDAR = "id string, summary string, description string, location string, status string, start struct<date:string,dateTime:string>, `end` struct<date:string,dateTime:string>, organizer struct<email:string,displayName:string>, attendees array<struct<email:string,displayName:string,responseStatus:string>>, updated string"


def start_seconds(start: Column) -> Column:
    """A whole day starts at midnight UTC; a moment is RFC 3339."""
    moment = F.try_to_timestamp(F.regexp_replace(start["dateTime"], "T", " "))
    return F.coalesce(moment.cast("long"), F.try_to_timestamp(start["date"], F.lit("yyyy-MM-dd")).cast("long"))


def calendar_events(raw: DataFrame, adapter: str = "calendar", calendar: str = "primary") -> DataFrame:
    body = F.concat_ws("\n\n", F.nullif("summary", F.lit("")), F.nullif("location", F.lit("")), F.nullif("description", F.lit("")))
    return raw.withColumn("ts", start_seconds(F.col("start"))).where("ts IS NOT NULL").select(ledger_id(adapter, F.lit(calendar), F.col("id")).alias("event_id"), "ts", F.lit("calendar").alias("channel"), F.array(F.lit("text")).alias("content_types"), body.alias("content"), F.lit("observed").alias("direction"), ledger_id(adapter, F.lit(calendar)).alias("thread_id"), F.lit(adapter).alias("source_adapter"), F.concat_ws(":", F.lit(calendar), "id").alias("source_id"), "status", "organizer", "attendees")


def calendar_participants(events: DataFrame) -> DataFrame:
    people = events.select("event_id", F.col("organizer.email").alias("email"), F.col("organizer.displayName").alias("name"), F.lit("organizer").alias("role")).unionByName(events.select("event_id", F.explode("attendees").alias("a")).select("event_id", F.col("a.email").alias("email"), F.col("a.displayName").alias("name"), F.lit("attendee").alias("role")))
    return people.where("coalesce(email, '') != ''").select("event_id", contact_id("email", F.lower(F.trim("email"))).alias("contact_id"), "role", F.lower(F.trim("email")).alias("email"), "name").dropDuplicates(["event_id", "contact_id", "role"])


def calendar_state(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.lit("unknown").alias("read_state"), F.lit(False).alias("flagged"), F.lit(False).alias("archived"), F.coalesce("status", F.lit("unknown")).alias("status"))


ADDRESS_BOOK = "resourceName string, names array<struct<displayName:string>>, emailAddresses array<struct<value:string>>, phoneNumbers array<struct<value:string>>"


def address_book(raw: DataFrame, source: str = "google_contacts") -> DataFrame:
    """Sightings (raw_id, type, value, display_name, source, ts) of people's distinct identifiers."""
    ids = F.concat(F.transform(F.coalesce("emailAddresses", F.array().cast("array<struct<value:string>>")), lambda x: F.struct(F.lit("email").alias("type"), x["value"].alias("value"))), F.transform(F.coalesce("phoneNumbers", F.array().cast("array<struct<value:string>>")), lambda x: F.struct(F.lit("phone").alias("type"), x["value"].alias("value"))))
    rows = raw.select(F.col("resourceName").alias("raw_id"), F.get(F.col("names.displayName"), F.lit(0)).alias("display_name"), F.explode(F.array_distinct(ids)).alias("i"))
    return rows.select("raw_id", "i.type", "i.value", "display_name", F.lit(source).alias("source"), F.lit(0).cast("long").alias("ts")).where("coalesce(value, '') != ''")


def link_address_book(sightings: DataFrame, identifiers: DataFrame, links: DataFrame) -> DataFrame:
    """(raw_id, person_id): the person that any of an entry's identifiers belongs to already, or a new one."""
    own = sightings.withColumn("normalized", fid.identifier(F.col("value"), F.col("type")))
    known = own.join(identifiers.select("type", "normalized", "contact_id"), ["type", "normalized"]).join(links, "contact_id").groupBy("raw_id").agg(F.min("person_id").alias("__person"))
    return own.select("raw_id").distinct().join(known, "raw_id", "left").select("raw_id", F.coalesce("__person", F.sha2(F.concat(F.lit("person|"), F.col("raw_id")), 256)).alias("person_id"), F.col("__person").isNull().alias("is_new"))


POSTS = "id string, text string, createdAt string, conversationId string, inReplyToStatusId string, author struct<username:string,name:string>"


def post_seconds(created: Column) -> Column:
    """`Wed Oct 10 20:19:24 +0000 2018`; the weekday says nothing new."""
    return F.try_to_timestamp(F.regexp_replace(created, r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")).cast("long")


def posts(raw: DataFrame, kind: str, adapter: str = "x") -> DataFrame:
    """Bookmarks, likes or mentions; all are observed."""
    own = F.concat_ws(":", F.lit(kind), "id")
    return raw.select(ledger_id(adapter, own).alias("event_id"), post_seconds(F.col("createdAt")).alias("ts"), F.lit("x").alias("channel"), F.array(F.lit("text")).alias("content_types"), F.col("text").alias("content"), F.lit("observed").alias("direction"), F.when(F.col("conversationId").isNotNull(), ledger_id(adapter, F.col("conversationId"))).alias("thread_id"), F.when(F.col("inReplyToStatusId").isNotNull(), ledger_id(adapter, F.lit(kind), F.col("inReplyToStatusId"))).alias("reply_to"), F.lit(adapter).alias("source_adapter"), own.alias("source_id"), contact_id("handle", fid.handle(F.col("author.username"))).alias("contact_id"), F.col("author.name").alias("author_name")).dropDuplicates(["source_adapter", "source_id"])
