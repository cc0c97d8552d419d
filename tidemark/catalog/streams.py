"""Streams: the ledger arrives in files, a few at a time, and ends as if it had come at once."""

from __future__ import annotations

import os
import sqlite3
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.base import DIRECTION, LEDGER, ledger, query
from tidemark.operators import episodes
from tidemark.plans.components import shared_folder
from tidemark.plans.state import VersionedTable
from tidemark.sources import stores
from tidemark.streaming import live

FIELDS = "event_id string, ts long, channel string, content string, direction string, thread_id string, source_adapter string, source_id string"
FILES, FILES_AT_ONCE = 6, 2


def _arrived(spark, sf_dir, twice: str):
    """(folder, stream) of JSON files; the events that meet `twice` are in them twice."""
    folder = f"{shared_folder(spark)}/arrived-{uuid.uuid4().hex}"
    rows = ledger(spark, sf_dir).selectExpr("cast(event_id as string) AS event_id", "ts", "channel", "content", "direction", "cast(thread_id as string) AS thread_id", "'a' AS source_adapter", "cast(event_id as string) AS source_id")
    rows.union(rows.where(twice)).repartition(FILES, "ts", "event_id").write.json(f"{folder}/in")
    return folder, live.file_stream(spark, f"{folder}/in", FIELDS, most_files=FILES_AT_ONCE)


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, event_type AS channel, {DIRECTION} AS direction, CAST(user_id AS VARCHAR) AS thread_id FROM events")
def streamed_ledger(spark, sf_dir):
    folder, stream = _arrived(spark, sf_dir, "ts % 3 = 0")
    kept = VersionedTable(spark, f"{folder}/ledger", schemas.EVENTS, schemas.KEYS["events"])
    stream.writeStream.foreachBatch(live.upsert_sink(kept)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept.read().select("event_id", "ts", "channel", "direction", "thread_id")


@query(f"WITH {LEDGER} SELECT ts // 86400 * 86400 AS start, channel, direction, COUNT(*) AS n FROM ledger GROUP BY ALL")
def streamed_counts(spark, sf_dir):
    """The live timeline after the last batch."""
    folder, stream = _arrived(spark, sf_dir, "false")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/counts/epoch={epoch}")

    live.windowed_counts(stream, delay="400 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # Each batch holds the windows that it changed: the last word on each counts.
    latest = spark.read.parquet(f"{folder}/counts").groupBy("start", "channel", "direction").agg(F.max_by("n", "epoch").alias("n"))
    return latest.select(F.col("start").cast("long").alias("start"), "channel", "direction", "n")


@query(f"WITH {LEDGER}, own AS (SELECT * FROM ledger WHERE thread_id IN (SELECT thread_id FROM ledger WHERE event_id % 97 = 0)), g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts - p > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, LAG(ts) OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS p FROM own)) SELECT thread_id, MIN(ts) AS start_time, MAX(ts) AS end_time, COUNT(*) AS event_count FROM g GROUP BY thread_id, k")
def recomputed_episodes(spark, sf_dir):
    """Late events: the episodes of every thread that a batch touches, from the whole ledger."""
    own = ledger(spark, sf_dir)
    members = live.recompute_threads(own, own.where("event_id % 97 = 0"), lambda events: episodes.time_gap(events, 86400))
    return episodes.rows(members, "q").select("thread_id", "start_time", "end_time", "event_count")


GAP, CHUNK = 86400, 10 * 86400


@query(f"WITH {LEDGER}, g AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, LAG(ts) OVER (PARTITION BY thread_id ORDER BY ts, event_id) AS p FROM ledger)) SELECT CAST(thread_id AS VARCHAR) AS thread_id, MIN(ts) AS start_time, MAX(ts) AS end_time, COUNT(*) AS event_count FROM g GROUP BY thread_id, k")
def live_episodes(spark, sf_dir):
    """Episodes as they close while the ledger arrives, a third of it ten days late."""
    folder = f"{shared_folder(spark)}/arrived-{uuid.uuid4().hex}"
    rows = ledger(spark, sf_dir).selectExpr("cast(event_id as string) AS event_id", "ts", "cast(thread_id as string) AS thread_id", f"ts div {CHUNK} + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS chunk")
    rows.where("ts IS NOT NULL").repartition("chunk").write.partitionBy("chunk").json(f"{folder}/rows")
    top = rows.agg(F.max("ts")).first()[0] or 0
    fields = "event_id string, ts long, thread_id string"
    # The last event moves the watermark past all others.
    spark.createDataFrame([("end", top + 100 * CHUNK, "end")], fields).write.json(f"{folder}/rows/chunk={top // CHUNK + 9}")
    chunks = sorted(int(r[0]) for r in spark.read.schema(fields + ", chunk long").json(f"{folder}/rows").select("chunk").distinct().collect())  # one for each ten days
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for chunk in chunks:
            spark.read.schema(fields).json(f"{folder}/rows/chunk={chunk}").write.mode("append").json(f"{folder}/in")
            stream = live.file_stream(spark, f"{folder}/in", fields)
            # Every chunk is a run of its own, that goes on from the checkpoint.
            live.live_episodes(stream, GAP, delay="21 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{folder}/out").where("first_event_id != 'end'").select("thread_id", "start_time", "end_time", "event_count")


@query(f"WITH {LEDGER} SELECT event_id, ts, channel, thread_id, 1 AS times FROM ledger")
def store_stream(spark, sf_dir):
    """The ledger from stores that are filled in two steps, by a stream that is started three times."""
    folder = f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    at = folder.removeprefix("file://")
    rows = ledger(spark, sf_dir).select("event_id", "ts", "channel", "thread_id")
    middle = rows.agg(F.expr("min(ts) + (max(ts) - min(ts)) div 2")).first()[0] or 0

    def fill(batches):
        """Adds a task's rows to a store of their own, whole or not at all."""
        number, own = TaskContext.get().partitionId(), [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        os.makedirs(f"{at}/stores", exist_ok=True)
        db = sqlite3.connect(f"{at}/stores/{number}.db", timeout=60)
        with db:
            db.execute("CREATE TABLE IF NOT EXISTS events (event_id INTEGER PRIMARY KEY, ts INTEGER, channel TEXT, thread_id INTEGER)")
            db.executemany("INSERT OR IGNORE INTO events VALUES (?, ?, ?, ?)", own)
        db.close()
        yield pa.RecordBatch.from_pydict({"n": [len(own)]})

    for part in (F.col("ts") <= middle, F.col("ts") > middle, F.lit(False)):
        rows.where(part).repartition(4, "event_id").mapInArrow(fill, "n long").write.format("noop").mode("overwrite").save()
        stream = stores.store_stream(spark, f"{at}/stores", "events", "event_id long, ts long, channel string, thread_id long", id="event_id")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_id", "ts", "channel", "thread_id").agg(F.count("*").alias("times"))
