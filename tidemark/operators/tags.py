"""Tags on events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.events import name_matches
from tidemark.plans.state import insert_new

TAG_TYPES = ("topic", "entity", "emotion", "project", "context")
KEY = ["event_id", "tag_type", "value"]


def listing(tags: DataFrame, limit: int | None = None) -> DataFrame:
    out = tags.orderBy(F.desc("created_at"), *KEY)
    return out.limit(limit) if limit else out


def of_event(tags: DataFrame, event_id) -> DataFrame:
    return tags.where(F.col("event_id") == event_id).orderBy("tag_type", "value")


def of_type(tags: DataFrame, tag_type: str) -> DataFrame:
    return tags.where(F.col("tag_type") == tag_type).orderBy("value", "event_id")


def counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_type", "value").agg(F.count("*").alias("n"))


def add(tags: DataFrame, events: DataFrame, tag_type: str, value: str, created_at: int, confidence: float | None = None, source: str = "user") -> DataFrame:
    """`tags` with one for each of `events` (event_id) that has none like it yet."""
    if tag_type not in TAG_TYPES:
        raise ValueError(f"unknown tag type: {tag_type}")
    new = events.select("event_id").distinct().select("event_id", F.lit(tag_type).alias("tag_type"), F.lit(value).alias("value"), F.lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(created_at).cast("long").alias("created_at"))
    return insert_new(tags, new, KEY)


def bulk_events(events: DataFrame, channel: str | None = None, since: int | None = None, until: int | None = None, person: str | None = None, participants: DataFrame | None = None, links: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """The events that a bulk tag goes to."""
    if channel:
        events = events.where(F.col("channel") == channel)
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if person:
        who = persons.where(name_matches(person, F.col("canonical_name"), F.col("display_name"))).select("person_id")
        ids = participants.join(links.join(who, "person_id", "left_semi").select("contact_id").distinct(), "contact_id", "left_semi").select("event_id").distinct()
        events = events.join(ids, "event_id", "left_semi")
    return events


def delete(tags: DataFrame, event_id, tag_type: str, value: str) -> DataFrame:
    return tags.where(~((F.col("event_id") == event_id) & (F.col("tag_type") == tag_type) & (F.col("value") == value)))
