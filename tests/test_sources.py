"""Sources: change logs in any order, deep and cyclic turn trees, statements that hide a write."""

import json
import random

import pytest
from pyspark.errors import AnalysisException

from tidemark.sources import files, mail, sessions


def record(history_id, kind, message, labels=()):
    return {"id": None if history_id is None else str(history_id), kind: [{"message": {"id": message, "labelIds": list(labels)}, "labelIds": list(labels)}]}


def replayed(records):
    """{message: (deleted, labels)} of records taken one after another, by history id."""
    out = {}
    order = {"messagesAdded": 0, "labelsAdded": 1, "labelsRemoved": 2, "messagesDeleted": 3}
    for r in sorted(records, key=lambda r: (int(r["id"]), order[next(k for k in r if k != "id")])):
        (kind, (c,)), = ((k, v) for k, v in r.items() if k != "id")
        gone, labels = out.get(c["message"]["id"], (False, set()))
        if kind == "messagesAdded":
            gone, labels = False, set(c["message"]["labelIds"])
        elif kind == "messagesDeleted":
            gone, labels = True, set()
        elif not gone:
            labels = labels | set(c["labelIds"]) if kind == "labelsAdded" else labels - set(c["labelIds"])
        out[c["message"]["id"]] = gone, labels
    return {m: (g, sorted(x)) for m, (g, x) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_history_in_any_order_and_again(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["messagesAdded", "messagesDeleted", "labelsAdded", "labelsAdded", "labelsRemoved"]
    records, gone = [], set()
    for i in range(1, 200):
        kind, message = rng.choice(kinds), f"m{rng.randint(0, 12)}"
        # A log has no label changes of a message that is gone.
        if message in gone and kind != "messagesAdded":
            continue
        gone = gone | {message} if kind == "messagesDeleted" else gone - {message}
        records.append(record(i, kind, message, rng.sample(["INBOX", "UNREAD", "STARRED", "x"], 2)))
    want = replayed(records)
    shuffled = records + rng.sample(records, 60)
    rng.shuffle(shuffled)
    state = spark.createDataFrame([], mail.HISTORY_STATE)
    for n, part in enumerate((shuffled[:80], shuffled[80:], shuffled[:80])):
        (tmp_path / f"{n}").mkdir()
        (tmp_path / f"{n}" / "h.json").write_text("\n".join(map(json.dumps, part)))
        state = mail.fold_history(state, mail.history_changes(mail.read_history(spark, f"{tmp_path}/{n}")))
    assert {r.message_id: (r.deleted, r.labels) for r in mail.history_labels(state).collect()} == want


def test_odd_history(spark, tmp_path):
    odd = [record(None, "messagesAdded", "a", ["x"]), record("soon", "messagesAdded", "a", ["x"]), record(5, "labelsAdded", None, ["x"]), {"id": "7"}, record(9, "labelsAdded", "b", ["x", "x"]), record(9, "labelsRemoved", "b", ["x"]), record(8, "messagesAdded", "c", [])]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, odd)) + "\nnot json")
    changes = mail.history_changes(mail.read_history(spark, str(tmp_path)))
    state = mail.fold_history(spark.createDataFrame([], mail.HISTORY_STATE), changes)
    assert {r.message_id: (r.deleted, r.labels) for r in mail.history_labels(state).collect()} == {"b": (False, []), "c": (False, [])}
    events = spark.createDataFrame([("gmail:b", ["x", "INBOX"]), ("gmail:z", ["y"])], "event_id string, labels array<string>")
    assert sorted(tuple(r) for r in mail.relabelled(events, mail.history_labels(state)).collect()) == [("gmail:b", []), ("gmail:z", ["y"])]
    values = mail.history_watermark(spark.createDataFrame([("gmail", mail.HISTORY_KEY, "12", 1), ("x", "k", "v", 1)], "adapter string, key string, value string, updated_at long"), changes, "gmail", 99)
    assert sorted((r.adapter, r.value) for r in values.collect()) == [("gmail", "12"), ("x", "v")]
    newer = mail.history_watermark(values, spark.createDataFrame([("m", None, True, 40)], mail.HISTORY_STATE), "gmail", 99)
    assert sorted((r.adapter, r.value) for r in newer.collect()) == [("gmail", "40"), ("x", "v")]


def test_turns_of_any_depth(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("cast(id as string) AS id", "CASE WHEN id > 0 THEN cast(id - 1 as string) END AS parent_turn_id")
    got = sessions.turn_depths(chain)
    assert got.count() == n and got.where("root_id = '0' AND depth = cast(id as int)").count() == n


def test_cycles_orphans_and_repeats(spark):
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("o", "nowhere"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), (None, "a"), ("d", "a"), ("d", "c")]
    got = {r.id: (r.root_id, r.depth) for r in sessions.turn_depths(spark.createDataFrame(rows, "id string, parent_turn_id string")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "o": ("o", 0), "x": (None, None), "y": (None, None), "z": (None, None), "s": (None, None), "d": ("a", 1)}
    assert sessions.turn_depths(spark.createDataFrame([], "id string, parent_turn_id string")).count() == 0


WRITES = [
    "WITH x AS (SELECT 1 AS n) INSERT INTO guarded SELECT n FROM x",
    "FROM (SELECT 1 AS n) s INSERT INTO guarded SELECT n INSERT INTO guarded SELECT n + 1",
    "/* SELECT */ INSERT OVERWRITE guarded SELECT 1",
    "WITH x AS (SELECT 1 AS n) FROM x INSERT INTO guarded SELECT n",
    "DELETE FROM guarded",
    "CREATE TEMP VIEW w AS SELECT 1",
    "DROP TABLE guarded",
    "CACHE TABLE guarded",
    "SET spark.x=1",
    "EXPLAIN INSERT INTO guarded SELECT 1",
    "BEGIN INSERT INTO guarded SELECT 1; END",
]


@pytest.mark.parametrize("statement", WRITES)
def test_statements_that_write_are_refused(spark, statement):
    spark.sql("CREATE TABLE IF NOT EXISTS guarded (n INT) USING parquet")
    try:
        with pytest.raises((PermissionError, AnalysisException)):
            files.raw_sql(spark, statement)
        assert spark.table("guarded").count() == 0
    finally:
        spark.sql("DROP TABLE guarded")


def test_queries_of_all_shapes_pass(spark):
    t = spark.range(3)
    for sql, n in (("WITH x AS (WITH y AS (SELECT * FROM t) SELECT * FROM y) SELECT * FROM x WHERE id IN (SELECT max(id) FROM t)", 1), ("SELECT * FROM t UNION ALL SELECT 9", 4), ("SELECT id, count(*) OVER () FROM t ORDER BY id LIMIT 2", 2), ("FROM t SELECT id", 3), ("VALUES (1), (2)", 2), ("SELECT x FROM t LATERAL VIEW explode(array(1, 2)) AS x", 6)):
        assert files.raw_sql(spark, sql, {"t": t}).count() == n
