"""Reading the ledger: event filters, participants, people, timelines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("sent", "received", "observed", "created", "updated", "deleted")


@dataclass(frozen=True)
class EventFilters:
    """Both time bounds are inclusive epoch seconds. % and _ in `person` are wildcards."""

    person: str | None = None
    channel: str | None = None
    since: int | None = None
    until: int | None = None
    direction: str | None = None
    limit: int = 100


def best_link(links: DataFrame) -> DataFrame:
    """(contact_id, person_id): each contact's most trusted link, then the latest, then by id.

    Computed once and joined, in place of a subquery for each row.
    """
    return links.groupBy("contact_id").agg(F.max_by("person_id", F.struct("confidence", "last_seen_at", "person_id")).alias("person_id"))


def best_identifier(identifiers: DataFrame) -> DataFrame:
    """(contact_id, identifier): a telephone number before an e-mail address."""
    rank = F.when(F.col("type") == "phone", 1).otherwise(2)
    return identifiers.where(F.col("type").isin("phone", "email")).groupBy("contact_id").agg(F.min_by("value", F.struct(rank, "value")).alias("identifier"))


#: Three operators name a contact in three orders.
LABEL_ORDER = {
    "timeline": ("person_display", "person_canonical", "contact_display", "identifier"),
    "episode": ("person_canonical", "contact_display", "identifier"),
    "participant": ("person_display", "person_canonical", "contact_display"),
}


def labels(contacts: DataFrame, links: DataFrame, persons: DataFrame, identifiers: DataFrame | None = None, use: str = "timeline", default: str | None = "Unknown") -> DataFrame:
    """(contact_id, person_id, label) of every contact."""
    out = contacts.select("contact_id", F.col("display_name").alias("contact_display")).join(best_link(links), "contact_id", "left")
    out = out.join(persons.select("person_id", F.col("display_name").alias("person_display"), F.col("canonical_name").alias("person_canonical")), "person_id", "left")
    order = LABEL_ORDER[use]
    if "identifier" in order:
        out = out.join(best_identifier(identifiers), "contact_id", "left")
    label = F.coalesce(*[F.col(c) for c in order], *([F.lit(default)] if default else []))
    return out.select("contact_id", "person_id", label.alias("label"))


def name_matches(name: str, *columns: Column) -> Column:
    """Whether a name contains `name`, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).like(f"%{name.lower()}%"), F.lit(False))
    return out


def event_ids_of(name: str, participants: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """Distinct event_ids in which a person of that name takes part."""
    who = persons.where(name_matches(name, F.col("canonical_name"), F.col("display_name"))).select("person_id")
    return participants.join(links.join(who, "person_id", "left_semi").select("contact_id").distinct(), "contact_id", "left_semi").select("event_id").distinct()


def conditions(f: EventFilters) -> Column:
    if f.direction and f.direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {f.direction}")
    out = F.lit(True)
    if f.channel:
        out = out & (F.col("channel") == f.channel)
    if f.since is not None:
        out = out & (F.col("ts") >= f.since)
    if f.until is not None:
        out = out & (F.col("ts") <= f.until)
    if f.direction:
        out = out & (F.col("direction") == f.direction)
    return out


def query_events(events: DataFrame, filters: EventFilters, participants: DataFrame | None = None, links: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """The latest events that meet the filters; a semi-join stands for the distinct of a join."""
    out = events.where(conditions(filters))
    if filters.person:
        out = out.join(event_ids_of(filters.person, participants, links, persons), "event_id", "left_semi")
    return out.orderBy(F.desc("ts"), "event_id").limit(filters.limit if filters.limit > 0 else 100)


ROLES = ("sender", "recipient", "cc")


def with_participants(events: DataFrame, participants: DataFrame, contact_labels: DataFrame) -> DataFrame:
    """`events` with participants (contact_id, name, role), senders first: one join for all events."""
    rank = F.lit(4)
    for i, role in reversed(list(enumerate(ROLES, 1))):
        rank = F.when(F.col("role") == role, i).otherwise(rank)
    named = participants.join(contact_labels.select("contact_id", F.col("label").alias("name")), "contact_id")
    lists = named.join(events.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "contact_id", "name", "role"))).alias("p"))
    out = events.join(lists, "event_id", "left")
    return out.withColumn("participants", F.transform("p", lambda p: F.struct(p["contact_id"].alias("contact_id"), p["name"].alias("name"), p["role"].alias("role")))).drop("p")


def by_prefix(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """The row that a shortened id means."""
    return table.where(F.col(column).startswith(prefix)).orderBy(column).limit(1)


# --- periods ---


def period(arg: str, zone: str = "UTC") -> tuple[int, int]:
    """Half-open epoch seconds of a local day (YYYY-MM-DD), month (YYYY-MM) or year (YYYY)."""
    parts = [int(x) for x in arg.split("-")]
    if not 1 <= len(parts) <= 3 or len(arg) != (4, 7, 10)[len(parts) - 1]:
        raise ValueError(f"not a day, month or year: {arg}")
    start = date(*(parts + [1, 1])[:3])
    if len(parts) == 3:
        end = start + timedelta(days=1)
    elif len(parts) == 2:
        end = date(start.year + start.month // 12, start.month % 12 + 1, 1)
    else:
        end = date(start.year + 1, 1, 1)
    return _epoch(start, zone), _epoch(end, zone)


def _epoch(day: date, zone: str) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp())


def today(now: float, zone: str = "UTC") -> tuple[int, int]:
    day = datetime.fromtimestamp(now, timezone.utc).astimezone(ZoneInfo(zone)).date()
    return _epoch(day, zone), _epoch(day + timedelta(days=1), zone)


def this_week(now: float, zone: str = "UTC") -> tuple[int, int]:
    """From Monday on, seven days."""
    day = datetime.fromtimestamp(now, timezone.utc).astimezone(ZoneInfo(zone)).date()
    monday = day - timedelta(days=day.weekday())
    return _epoch(monday, zone), _epoch(monday + timedelta(days=7), zone)


def local_day(ts: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone)) if zone != "UTC" else F.to_date(F.timestamp_seconds(ts))


# --- aggregates ---


def timeline(events: DataFrame, participants: DataFrame, contact_labels: DataFrame, start: int, end: int, zone: str = "UTC") -> DataFrame:
    """(day, sender, channel, direction, n) in a half-open period; an event with two senders counts for each."""
    senders = participants.where("role = 'sender'").join(contact_labels.select("contact_id", "label"), "contact_id", "left").select("event_id", "label")
    own = events.where((F.col("ts") >= start) & (F.col("ts") < end)).join(senders, "event_id", "left")
    return own.groupBy(local_day(F.col("ts"), zone).cast("string").alias("day"), F.coalesce("label", F.lit("Unknown")).alias("sender"), "channel", "direction").agg(F.count("*").alias("n"))


def day_totals(events: DataFrame, start: int, end: int, zone: str = "UTC") -> DataFrame:
    return events.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(local_day(F.col("ts"), zone).cast("string").alias("day")).agg(F.count("*").alias("total"))


def timeline_days(flat: DataFrame, totals: DataFrame) -> DataFrame:
    """Per day: total, and counts by sender, channel and direction as maps, newest day first."""
    out = totals
    for name in ("sender", "channel", "direction"):
        part = flat.groupBy("day", name).agg(F.sum("n").alias("n")).groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(name, F.lit("")), "n")))).alias(f"by_{name}"))
        out = out.join(part, "day", "left")
    return out.orderBy(F.desc("day"))


def people(persons: DataFrame, links: DataFrame, participants: DataFrame, events: DataFrame) -> DataFrame:
    """Every person with the number of distinct events and the last one's time, busiest first."""
    seen = links.select("person_id", "contact_id").join(participants.select("contact_id", "event_id"), "contact_id").select("person_id", "event_id").distinct()
    counts = seen.join(events.select("event_id", "ts"), "event_id").groupBy("person_id").agg(F.count("*").alias("event_count"), F.max("ts").alias("last_event_at"))
    out = persons.join(counts, "person_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    return out.orderBy(F.desc("event_count"), "canonical_name", "person_id")


def search_people(persons: DataFrame, links: DataFrame, identifiers: DataFrame, contacts: DataFrame, name: str) -> DataFrame:
    """Persons whose names, contacts' names or identifiers contain `name`."""
    own = persons.where(name_matches(name, F.col("canonical_name"), F.col("display_name"))).select("person_id")
    hits = contacts.where(name_matches(name, F.col("display_name"))).select("contact_id").union(identifiers.where(name_matches(name, F.col("value"))).select("contact_id"))
    return persons.join(own.union(links.join(hits.distinct(), "contact_id", "left_semi").select("person_id")).distinct(), "person_id", "left_semi")


def profile(facts: DataFrame) -> DataFrame:
    """(person_id, category, facts) with the facts of a category in order."""
    return facts.groupBy("person_id", "category").agg(F.sort_array(F.collect_list(F.struct("fact_type", "fact_value", "confidence"))).alias("facts"))


def top_threads(events: DataFrame, n: int) -> DataFrame:
    """The busiest threads; one whose id has 'chat' in it is a group."""
    counts = events.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.count("*").alias("event_count"), F.max("channel").alias("channel"), F.max("ts").alias("last_ts"))
    return counts.withColumn("is_group", F.lower(F.col("thread_id").cast("string")).like("%chat%")).orderBy(F.desc("event_count"), "thread_id").limit(n)


def has_content_type(content_types: Column, name: str) -> Column:
    """Membership in a JSON array of tags; text that isn't one is searched as it is."""
    parsed = F.from_json(content_types, "array<string>")
    return F.when(parsed.isNotNull(), F.array_contains(parsed, name)).otherwise(F.contains(content_types, F.lit(name)))
