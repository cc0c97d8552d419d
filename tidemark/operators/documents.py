"""Versioned documents: a change is an event, the head its latest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash
from tidemark.plans.state import merge_df


def versions(inputs: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Document inputs (doc_key, channel, title, description, content, ts) as events.

    An input whose hash equals the version before it is skipped. `reply_to` is the event of the
    version before, `action` is created or updated. With `heads`, versions go on from there.
    """
    hashed = inputs.withColumn("content_hash", content_hash(F.col("title"), F.col("description"), F.col("content")))
    w = Window.partitionBy("doc_key").orderBy("ts", "content_hash")
    before = F.lag("content_hash").over(w)
    if heads is not None:
        head = heads.select("doc_key", F.col("content_hash").alias("__hash"), F.col("event_id").alias("__event"))
        hashed = hashed.join(head, "doc_key", "left")
        before = F.coalesce(before, F.col("__hash"))
    changed = hashed.withColumn("__before", before).where(~F.col("content_hash").eqNullSafe(F.col("__before")))
    event = F.sha2(F.concat_ws("|", "doc_key", "content_hash", F.col("ts").cast("string")), 256)
    reply = F.lag("event_id").over(w)
    if heads is not None:
        reply = F.coalesce(reply, F.col("__event"))
    out = changed.withColumn("event_id", event).withColumn("reply_to", reply)
    return out.withColumn("action", F.when(F.col("reply_to").isNull(), "created").otherwise("updated")).drop("__before", "__hash", "__event")


def heads(events: DataFrame) -> DataFrame:
    """The latest version of every document."""
    order = F.struct("ts", "content_hash", "event_id")
    names = ["event_id", "channel", "title", "description", "content_hash"]
    return events.groupBy("doc_key").agg(*[F.max_by(c, order).alias(c) for c in names])


def upsert(state: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new heads, new events) from the heads so far and a batch of inputs."""
    new = versions(inputs, state)
    return merge_df(state, heads(new), ["doc_key"]), new


def track_retrieval(state: DataFrame, results: DataFrame, query: str, ts: int) -> tuple[DataFrame, DataFrame]:
    """(heads with counts, log rows) for the documents that a search returned."""
    log = results.select(F.concat_ws(":", "doc_key", F.lit(str(ts))).alias("retrieval_id"), "doc_key", F.lit(query).alias("query"), "score", F.lit(ts).cast("long").alias("ts"))
    counts = log.groupBy("doc_key").agg(F.count("*").alias("retrieval_count"), F.max("ts").alias("last_retrieved_at"))
    return merge_df(state, counts, ["doc_key"], {"retrieval_count": "sum", "last_retrieved_at": "max"}), log


def stale_embeddings(docs: DataFrame, embeddings: DataFrame, id: str = "doc_key", hash: str = "content_hash") -> DataFrame:
    """Documents without an embedding, or whose embedding is of another text."""
    own = embeddings.select(F.col("target_id").alias("__id"), F.col("source_text_hash").alias("__hash"))
    out = docs.join(own, F.col(id) == F.col("__id"), "left")
    return out.where(F.col("__id").isNull() | F.col("__hash").isNull() | (F.col("__hash") != F.col(hash))).drop("__id", "__hash")


def unprocessed(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Items that have no row in `done`."""
    return items.join(done.select(*key).distinct(), key, "left_anti")


def not_in(items: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's NOT IN, with its trap: one null in the other column and no row is left."""
    values = other.select(F.col(other_column).alias("__v"))
    facts = values.agg(F.count("*").alias("n"), F.count_if(F.col("__v").isNull()).alias("nulls"))  # one row
    kept = items.join(values.where("__v IS NOT NULL").distinct(), F.col(column) == F.col("__v"), "left_anti").join(F.broadcast(facts))
    return kept.where((F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(column).isNotNull())).drop("n", "nulls")


def orphans(rows: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Rows to which no reference points; nulls among the references don't count."""
    for other, column in references:
        rows = rows.join(other.select(F.col(column).alias("__ref")).where("__ref IS NOT NULL").distinct(), F.col(key) == F.col("__ref"), "left_anti")
    return rows
