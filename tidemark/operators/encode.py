"""Episodes and records as text, one line an event, for embedding and analysis.

Lines are built by column expressions event by event; an episode's text is its lines in the
order of their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACTION_SNIPPET = 80


def stamp(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def reaction_snippet(text: Column) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) > REACTION_SNIPPET, F.concat(F.left(body, F.lit(REACTION_SNIPPET)), F.lit("…"))).otherwise(body)


def attachment_part(media_type: Column, filename: Column, mime_type: Column) -> Column:
    """[Image] and the like, or the file's name and type; null for what is left out."""
    name = F.trim(F.coalesce(filename, F.lit("file")))
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    base = F.when(base.isin("", "."), "file").otherwise(base)
    mime = F.trim(F.coalesce(mime_type, F.lit("")))
    shown = F.when(mime != "", F.concat(F.lit("[Attachment] "), base, F.lit(" ("), mime, F.lit(")"))).otherwise(F.concat(F.lit("[Attachment] "), base))
    known = F
    for kind in ("image", "video", "audio", "sticker"):
        known = known.when(media_type == kind, F.lit(f"[{kind.capitalize()}]"))
    return known.when(F.lower(name).endswith(".pluginpayloadattachment") | ((name == "") & (mime == "")), F.lit(None)).otherwise(shown)


def attachment_parts(attachments: DataFrame) -> DataFrame:
    """(event_id, parts) of the attachments in their order."""
    part = attachments.select("event_id", "attachment_id", attachment_part(F.col("media_type"), F.col("filename"), F.col("mime_type")).alias("part"))
    return part.where("part IS NOT NULL").groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("attachment_id", "part"))), lambda x: x["part"]).alias("parts"))


def membership_line(actor: Column, action: Column, members: Column) -> Column:
    """What a membership event says; null if nothing. `members` is an array of names."""
    actor = F.trim(F.coalesce(actor, F.lit("")))
    actor = F.when(actor == "Unknown", "").otherwise(actor)
    names = F.array_join(F.filter(F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda m: F.trim(m)), lambda m: (m != "") & (m != "Unknown")), ", ")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    added = F.when(names == "", "-> member joined").when(actor != "", say("-> ", actor, " added ", names)).otherwise(say("-> ", names, " joined"))
    gone = F.when((names == "") & (actor != ""), say("-> ", actor, " removed a member")).when(names == "", "-> member left").when((actor != "") & (actor != names), say("-> ", actor, " removed ", names)).otherwise(say("-> ", names, " left"))
    return F.when(action == "added", added).when(action == "removed", gone).when(names != "", say("-> membership update: ", names))


def event_lines(events: DataFrame) -> DataFrame:
    """`events` with `line` (null if an event says nothing).

    Columns: event_id, ts, name, content, content_types (array), reply_to, original (the text a
    reaction is to), action, members (array), parts (array of attachment parts).
    """
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "Unknown").otherwise(F.col("name"))
    at = F.concat(F.lit("["), stamp(F.col("ts")), F.lit("] "))
    emoji = F.trim(F.coalesce("content", F.lit("")))
    about = reaction_snippet(F.col("original"))
    reaction = F.when(emoji == "", F.lit(None)).when(about != "", F.concat(at, F.lit("-> "), name, F.lit(" "), emoji, F.lit(' to "'), about, F.lit('"'))).otherwise(F.concat(at, F.lit("-> "), name, F.lit(" reacted "), emoji))
    member = F.concat(at, membership_line(name, F.coalesce("action", F.lit("unknown")), F.col("members")))
    said = F.filter(F.concat(F.array(F.col("content")), F.coalesce("parts", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    message = F.when(F.size(said) > 0, F.concat(name, F.lit(": "), F.array_join(said, " ")))
    types = F.coalesce("content_types", F.array().cast("array<string>"))
    return events.withColumn("line", F.when(F.array_contains(types, "reaction"), reaction).when(F.array_contains(types, "membership"), member).otherwise(message))


def episode_texts(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(episode_id, text): each line ended by a line feed."""
    own = members.select("episode_id", "event_id", "position").join(lines.select("event_id", "line"), "event_id").where("line IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("position", "line")))
    return own.groupBy("episode_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def with_originals(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """`events` with `original`, the content of the event each replies to: a left self-join.

    Those that reply to nothing, mostly all, don't take part: they would come to one task.
    """
    source = ledger.select(F.col("event_id").alias("__id"), F.col("content").alias("original"))
    replies = events.where("reply_to IS NOT NULL").join(source, F.col("reply_to") == F.col("__id"), "left").drop("__id")
    return replies.unionByName(events.where("reply_to IS NULL").withColumn("original", F.lit(None).cast(source.schema["original"].dataType)))


def turn_quality_lines(events: DataFrame) -> DataFrame:
    """User: and Assistant: lines; no reactions, memberships or other directions."""
    types = F.coalesce("content_types", F.array().cast("array<string>"))
    own = events.where(F.col("direction").isin("sent", "received") & ~F.array_contains(types, "reaction") & ~F.array_contains(types, "membership"))
    body = F.trim(F.coalesce("content", F.lit("")))
    label = F.when(F.col("direction") == "received", "Assistant").otherwise("User")
    return own.withColumn("line", F.when(body != "", F.concat(label, F.lit(": "), body)))


def masked_lines(events: DataFrame, labels: DataFrame) -> DataFrame:
    """`event_lines` with each sender's label of the episode in place of the name."""
    return event_lines(events.drop("name").join(labels.select("episode_id", "contact_id", F.col("label").alias("name")), ["episode_id", "contact_id"], "left"))


def facet_text(facets: DataFrame) -> DataFrame:
    return facets.withColumn("text", F.concat_ws(": ", "facet_type", "value"))


def person_text(persons: DataFrame, facts: DataFrame) -> DataFrame:
    """(person_id, text): the name, then facts as `type: value`, by category and type."""
    own = facts.groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("category", "fact_type", "fact_value"))), lambda f: F.concat(f["fact_type"], F.lit(": "), f["fact_value"])).alias("facts"))
    out = persons.join(own, "person_id", "left")
    return out.select("person_id", F.array_join(F.filter(F.concat(F.array("canonical_name", F.when(F.col("display_name") != F.col("canonical_name"), F.col("display_name"))), F.coalesce("facts", F.array().cast("array<string>"))), lambda x: x.isNotNull()), "\n").alias("text"))


def document_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("description", F.lit("")), F.nullif("content", F.lit(""))))
