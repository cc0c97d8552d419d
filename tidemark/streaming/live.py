"""Live ledgers: incremental files, streamed episodes, the bus, supervision.

Checkpoint offsets take the place of high-water marks, so a late row with an old time is not
missed. Sinks are foreachBatch upserts: a batch that runs again changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.state import VersionedTable, latest
from tidemark.schemas import EVENTS


def file_stream(spark: SparkSession, path: str, schema=EVENTS, format: str = "json", most_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(format)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.load(path)


def deduplicated(stream: DataFrame, time_column: str = "event_time", delay: str = "1 day", key: tuple[str, ...] = ("source_adapter", "source_id")) -> DataFrame:
    """Each source row once; state older than the watermark is dropped."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(key))


def upsert_sink(table: VersionedTable, rules: dict[str, str] | None = None, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a versioned table, by the table's key.

    The table knows the last batch of each `stream` that it holds, so one that runs again after a
    crash changes nothing, whatever the rules are."""

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = latest(batch, table.key, [F.col(c).asc_nulls_last() for c in sorted(batch.columns) if c not in table.key])
        table.upsert(fresh, rules, "new_or_old", batch=(stream, epoch))

    return write


def append_sink(table: VersionedTable, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds rows with new keys."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.insert(batch.dropDuplicates(table.key), batch=(stream, epoch))

    return write


def _session(gap_seconds: int):
    """Windows that are parted by more than a gap. Times are whole seconds, so half a second more leaves no doubt of windows that touch."""
    return F.session_window("event_time", f"{gap_seconds * 1000 + 500} milliseconds").alias("w")


def session_windows(stream: DataFrame, gap_seconds: int, key: str = "thread_id", delay: str = "1 hour") -> DataFrame:
    """Time-gap episodes as session windows: (key, start_time, end_time, event_count)."""
    timed = stream.where(F.col(key).isNotNull()).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    grouped = timed.groupBy(key, _session(gap_seconds))
    return grouped.agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("event_count")).drop("w")


def live_episodes(stream: DataFrame, gap_seconds: int, key: str = "thread_id", delay: str = "1 hour") -> DataFrame:
    """Closed time-gap episodes: (key, first_event_id, start_time, end_time, event_count).

    Rows may come in any order within the delay; later ones are dropped. An episode is closed when
    the watermark has passed its end by the gap, as no row still to come can touch it then. They are
    session windows (see `session_windows`), so state is one row for each open episode, in any state
    store, and no row leaves the JVM. Rows without key or time are left out, rows that come twice
    count twice (see `deduplicated`).
    """
    source = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias(key), F.col("ts").cast("long").alias("ts"), F.col("event_id").cast("string").alias("event_id"), F.timestamp_seconds("ts").alias("event_time")).withWatermark("event_time", delay)
    grouped = source.groupBy(key, _session(gap_seconds))
    closed = grouped.agg(F.min(F.struct("ts", "event_id")).alias("first"), F.max("ts").alias("end_time"), F.count("*").alias("event_count"))
    return closed.select(key, F.col("first.event_id").alias("first_event_id"), F.col("first.ts").alias("start_time"), "end_time", "event_count")


def windowed_counts(stream: DataFrame, duration: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts by window, channel and direction, as a live timeline."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", duration).alias("w"), "channel", "direction").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "channel", "direction", "n")


def recompute_threads(ledger: DataFrame, batch: DataFrame, strategy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Episodes of the threads that a batch touches, from the whole ledger: late events find their place."""
    touched = batch.select("thread_id").distinct()
    return strategy(ledger.join(touched, "thread_id", "left_semi"))


def tail(spark: SparkSession, path: str, schema, type_prefix: str | None = None) -> DataFrame:
    """The bus as a stream of its files."""
    out = spark.readStream.schema(schema).parquet(path)
    return out.where(F.col("type").startswith(type_prefix)) if type_prefix else out


def next_backoff(seconds: float, least: float = 2.0, most: float = 30.0) -> float:
    return min(most, max(least, 2 * seconds))


def supervised(start: Callable[[], object], tries: int, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep, beat: Callable[[str], None] = lambda status: None) -> int:
    """Runs a query (`start` gives it) until it ends well, with doubling pauses after failures.

    Returns the number of restarts. `beat` is told running, restarting, stopped or failed."""
    pause, restarts = 0.0, 0
    while True:
        beat("running")
        try:
            start().awaitTermination()
            beat("stopped")
            return restarts
        except Exception:
            if stop() or restarts >= tries:
                beat("failed")
                raise
            restarts += 1
            pause = next_backoff(pause)
            beat("restarting")
            sleep(pause)
