import json
import random
import sqlite3
import time

import pytest

from tidemark import schemas
from tidemark.operators import episodes
from tidemark.plans.state import VersionedTable
from tidemark.sources import stores
from tidemark.streaming import live

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCHEMA = "event_id string, ts long, channel string, thread_id string, direction string, source_adapter string, source_id string"


def drop(path, name, *events):
    (path / name).write_text("\n".join(json.dumps(dict(zip("event_id ts channel thread_id direction source_adapter source_id".split(), e))) for e in events))


def event(i, ts, thread="t"):
    return (f"e{i}", ts, "c", thread, "sent", "a", str(i))


def test_upserts_of_files_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = VersionedTable(spark, f"file://{tmp_path}/table", schemas.EVENTS, schemas.KEYS["events"], buckets=4)
    drop(tmp_path / "in", "1.json", event(1, 10), event(1, 10), event(2, 20))
    for n in (2, 3):
        stream = live.file_stream(spark, str(tmp_path / "in"))
        stream.writeStream.foreachBatch(live.upsert_sink(table)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        assert table.read().count() == n
        # An older time comes late and is not missed.
        drop(tmp_path / "in", "2.json", event(3, 5), event(2, 20))


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.unset(PROVIDER)


def closed_after(spark, tmp_path, batches, gap, delay):
    """Episodes closed after files of events, one file a batch."""
    (tmp_path / "in").mkdir()
    stream = live.file_stream(spark, str(tmp_path / "in"), SCHEMA, most_files=1)
    for n, events in enumerate(batches):
        drop(tmp_path / "in", f"{n}.json", *events)
        live.live_episodes(stream, gap, delay=delay).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.thread_id, r.first_event_id, r.start_time, r.end_time, r.event_count) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_live_episodes_close_after_the_gap(spark, rocks, tmp_path):
    got = closed_after(spark, tmp_path, [[event(1, 1000), event(2, 1100), event(3, 1201), event(4, 1000, "u")]], 100, "0 seconds")
    assert got == [("t", "e1", 1000, 1100, 2), ("u", "e4", 1000, 1000, 1)]


def test_late_rows_widen_join_and_begin_episodes(spark, rocks, tmp_path):
    batches = [[event(1, 10_000), event(2, 10_010)], [event(3, 9_000), event(4, 10_130)], [event(5, 10_070), event(6, 9_960), event(7, 8_000)], [event(8, 100_000, "end")]]
    got = closed_after(spark, tmp_path, batches, 60, "1 hour")
    assert got == [("t", "e3", 9_000, 9_000, 1), ("t", "e6", 9_960, 10_130, 5), ("t", "e7", 8_000, 8_000, 1)]


def test_any_order_within_the_delay_gives_the_batch_episodes(spark, rocks, tmp_path):
    rng = random.Random(2)
    rows = [event(i, 20_000 + rng.randint(0, 6000), rng.choice("abc")) for i in range(120)]
    # A row comes at most 2,000 seconds after later ones.
    rows.sort(key=lambda e: e[1] + rng.randint(0, 1900))
    got = closed_after(spark, tmp_path, [rows[i : i + 30] for i in range(0, 120, 30)] + [[event(999, 10**6, "end")]], 50, "2000 seconds")
    df = spark.createDataFrame(rows, SCHEMA)
    want = episodes.rows(episodes.time_gap(df, 50), "q").collect()
    assert got == sorted((r.thread_id, r.first_event_id, r.start_time, r.end_time, r.event_count) for r in want)


def test_live_episodes_need_no_store_of_their_own(spark, tmp_path):
    batches = [[event(2, 50), event(1, 50), event(3, 150, "u"), (None, 40, "c", "t", "sent", "a", "0")], [event(4, 151), event(5, 150), event(6, None), event(7, 60, None)], [event(8, 9_000, "end")]]
    assert closed_after(spark, tmp_path, batches, 100, "10 minutes") == [("t", None, 40, 151, 5), ("u", "e3", 150, 150, 1)]


def test_stores_are_read_once_across_restarts(spark, tmp_path):
    (tmp_path / "stores").mkdir()

    def add(store, *rows):
        with sqlite3.connect(tmp_path / "stores" / store) as db:
            db.execute("CREATE TABLE IF NOT EXISTS m (id TEXT, ts INT, body TEXT)")
            db.executemany("INSERT INTO m VALUES (?, ?, ?)", rows)
        db.close()

    def run():
        stream = stores.store_stream(spark, f"{tmp_path}/stores", "m", "id string, ts long, body string", pieces=3)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add("a.db", ("a1", 5, "x"), ("a2", 5, None), ("a0", None, "x"), (None, 7, "no id"))
    assert run() == ["a0", "a1", "a2"]
    assert run() == ["a0", "a1", "a2"]
    # The same time with a greater id, a later time, and a store that is new.
    add("a.db", ("a3", 5, "x"), ("a4", 9, "x"))
    add("b.db", *[(f"b{i}", i, "x") for i in range(20)])
    (tmp_path / "stores" / "c.db").touch()
    assert run() == sorted(["a0", "a1", "a2", "a3", "a4", *[f"b{i}" for i in range(20)]])
    add("c.db", ("c1", 1, "x"))
    assert run().count("c1") == 1 and len(run()) == 26


def test_supervision_backs_off():
    waits, said, left = [], [], [2]

    class Query:
        def awaitTermination(self):
            if left[0]:
                left[0] -= 1
                raise RuntimeError("down")

    assert live.supervised(Query, 5, sleep=waits.append, beat=said.append) == 2
    assert waits == [2.0, 4.0] and said == ["running", "restarting", "running", "restarting", "running", "stopped"]
    assert live.next_backoff(20) == 30 and time.time()
