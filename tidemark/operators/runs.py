"""Analysis runs, job metrics and small state: logs that are appended and read by aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import Scan
from tidemark.plans.state import merge_df

FINAL = ("completed", "blocked")


def latest_status(log: DataFrame) -> DataFrame:
    """(analysis_type, episode_id, status) from a log with ts."""
    return log.groupBy("analysis_type", "episode_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def work_list(episodes: DataFrame, analysis_type: str, log: DataFrame) -> DataFrame:
    """Episodes to analyse: never run, still running or failed ones."""
    done = latest_status(log).where((F.col("analysis_type") == analysis_type) & F.col("status").isin(*FINAL))
    return episodes.join(done.select("episode_id"), "episode_id", "left_anti")


def advance(log: DataFrame, rows: DataFrame, status: str, ts: int, error: str | None = None) -> DataFrame:
    """The log with a new state of (analysis_type, episode_id) rows."""
    new = rows.select("analysis_type", "episode_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(ts).cast("long").alias("ts"))
    return log.unionByName(new, allowMissingColumns=True)


def status_counts(log: DataFrame) -> DataFrame:
    return latest_status(log).groupBy("analysis_type", "status").agg(F.count("*").alias("n"))


def job_metrics(jobs: DataFrame) -> DataFrame:
    """(kind, total, succeeded, failed, blocked, avg_ms, ...): averages are 0 where nothing ran."""
    phases = [c for c in jobs.columns if c.endswith("_ms")]
    return jobs.groupBy("kind").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "blocked")],
        *[F.coalesce(F.avg(p), F.lit(0.0)).alias(f"avg_{p}") for p in phases],
    )


def set_values(state: DataFrame, new: DataFrame) -> DataFrame:
    """(adapter, key, value, updated_at): the new value of a key counts."""
    return merge_df(state, new, ["adapter", "key"])


def start_job(jobs: DataFrame, row: DataFrame) -> DataFrame:
    return jobs.unionByName(row, allowMissingColumns=True)


def update_job(jobs: DataFrame, job_id: str, **values) -> DataFrame:
    for column, value in values.items():
        jobs = jobs.withColumn(column, F.when(F.col("job_id") == job_id, F.lit(value)).otherwise(F.col(column)))
    return jobs


def list_jobs(jobs: DataFrame, adapter: str | None = None, limit: int = 20) -> DataFrame:
    if adapter:
        jobs = jobs.where(F.col("adapter") == adapter)
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(limit)


def advance_watermark(state: DataFrame, batch: DataFrame, adapter: str) -> DataFrame:
    """Watermarks with the greatest (ts, id) of a batch; an empty batch leaves them as they are."""
    top = batch.agg(F.max(F.struct("ts", "id")).alias("m")).where("m IS NOT NULL").select(F.lit(adapter).alias("adapter"), F.col("m.ts").alias("last_ts"), F.col("m.id").alias("last_id"))
    return merge_df(state, top, ["adapter"])


def after_watermark(rows: DataFrame, ts: int | None, id: str | None) -> DataFrame:
    """Rows strictly after the tuple (ts, id)."""
    if ts is None:
        return rows
    after = F.col("ts") > ts
    return rows.where(after | ((F.col("ts") == ts) & (F.col("id") > id)) if id is not None else after)


def emit(bus: DataFrame, rows: DataFrame) -> DataFrame:
    """The bus with rows (type, adapter, event_id, payload_json, created_at) after its last seq.

    Numbers rise by one in the order of (created_at, type, event_id). They are given in parallel: rows
    are dealt out by range, each task numbers its own, and begins where the counts of those before end."""
    last = bus.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    numbered = Scan(rows, [], ["created_at", "type", "event_id"], divided=True).total(F.lit(1), "__n").result()
    return bus.unionByName(numbered.join(F.broadcast(last)).withColumn("seq", F.col("last") + F.col("__n")).select(*bus.columns))  # one row


def after_seq(bus: DataFrame, seq: int, limit: int = 100) -> DataFrame:
    return bus.where(F.col("seq") > seq).orderBy("seq").limit(limit)
