"""Versioned tables: no crash and no second writer loses or doubles rows; a batch costs what it touches."""

import os
import threading

import pytest

from tidemark.plans.state import VersionedTable
from tidemark.schemas import _schema

ROWS = _schema("k string, k2 string, n long, v string")
KEY = ["k", "k2"]


class Crash(Exception):
    pass


class Crashing(VersionedTable):
    """Stops at one step of a commit."""

    step = None

    def _written(self, rows):
        if self.step == "before rows":
            raise Crash
        out = super()._written(rows)
        if self.step == "after rows":
            raise Crash
        return out

    def _publish(self, version, manifest):
        if self.step == "before version":
            raise Crash
        return super()._publish(version, manifest)

    def _move(self, temporary, final):
        if self.step == "before link":
            raise Crash
        out = super()._move(temporary, final)
        if self.step == "after link":
            raise Crash
        return out


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


OLD = [("a", None, 1, "x"), ("b", "q", 2, "y"), (None, None, 3, "z")]
NEW = [("a", None, 5, None), ("c", "q", 7, "w")]
MERGED = sorted([("a", None, 6, "x"), ("b", "q", 2, "y"), (None, None, 3, "z"), ("c", "q", 7, "w")], key=str)


@pytest.mark.parametrize("step", ["before rows", "after rows", "before version", "before link", "after link"])
def test_a_crash_leaves_the_old_or_the_new_version(spark, tmp_path, step):
    table = Crashing(spark, f"file://{tmp_path}/t", ROWS, KEY, buckets=4)
    table.upsert(frame(spark, *OLD), {"n": "sum"}, "new_or_old", batch=("s", 0))
    before = held(table)
    assert before == sorted(OLD, key=str) and table.version() == 0
    table.step = step
    with pytest.raises(Crash):
        table.upsert(frame(spark, *NEW), {"n": "sum"}, "new_or_old", batch=("s", 1))
    assert held(table) == (MERGED if step == "after link" else before)
    # The batch runs again after the crash, and counts once.
    table.step = None
    for _ in range(2):
        table.upsert(frame(spark, *NEW), {"n": "sum"}, "new_or_old", batch=("s", 1))
        assert held(table) == MERGED and table.version() == 1
    table.step = step
    with pytest.raises(Crash):
        table.write(frame(spark, *NEW))
    assert held(table) == (sorted(NEW, key=str) if step == "after link" else MERGED)


def test_a_writer_that_comes_second_merges_again(spark, tmp_path):
    first, second = (VersionedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"], buckets=2) for _ in range(2))
    first.write(frame(spark, ("a", None, 1, "x")))
    publish, late = second._publish, []

    def overtaken(version, manifest):
        if not late:
            late.append(first.upsert(frame(spark, ("a", None, 10, "x"), ("b", None, 1, "x")), {"n": "sum"}))
        return publish(version, manifest)

    second._publish = overtaken
    assert second.upsert(frame(spark, ("a", None, 100, "x"), ("c", None, 1, "x")), {"n": "sum"}) == 2 and late == [1]
    assert [(r[0], r[2]) for r in held(second)] == [("a", 111), ("b", 1), ("c", 1)]
    # Nothing is left of the attempt that lost.
    named = {f for v in second._versions() for f in second._manifest(v)["buckets"].values()}
    assert {f"data/{n}" for n in os.listdir(tmp_path / "t" / "data")} == named


def test_many_writers_at_once(spark, tmp_path):
    def work(n):
        table = VersionedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"], buckets=3)
        for i in range(2):
            table.upsert(frame(spark, ("all", None, 1, None), (f"w{n}", None, 1, f"{i}")), {"n": "sum"})

    writers = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    table = VersionedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"], buckets=3)
    assert {r.k: r.n for r in table.read().collect()} == {"all": 6, "w0": 2, "w1": 2, "w2": 2} and table.version() == 5


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ROWS, ["k"], buckets=16)
    big = spark.range(20_000).selectExpr("cast(id as string) AS k", "cast(null as string) AS k2", "id AS n", "sha2(cast(id as string), 256) AS v")
    table.write(big)

    def size(name):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "t" / "data" / name) for f in files)

    (first,) = os.listdir(tmp_path / "t" / "data")
    table.upsert(frame(spark, ("17", None, -1, "new")))
    (second,) = set(os.listdir(tmp_path / "t" / "data")) - {first}
    assert size(second) * 8 < size(first) and table.read().count() == 20_000 and table.read().where("n = -1").count() == 1
    # An empty batch makes no version, unless it must be remembered.
    assert table.upsert(frame(spark)) == 1 and table.upsert(frame(spark), batch=("s", 4)) == 2 and table.upsert(frame(spark, ("x", None, 1, "x")), batch=("s", 4)) == 2
    assert table.read(0).where("n = -1").count() == 0
    table.vacuum(keep=1, older_than_seconds=-1)
    assert table.read().count() == 20_000 and table._versions() == [2]


def test_rows_without_key_and_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ROWS)
    assert table.version() is None and table.read().count() == 0
    assert table.write(frame(spark)) == 0 and table.read().count() == 0
    assert table.write(frame(spark, *OLD, *OLD)) == 1 and table.read().count() == 6
    keyed = VersionedTable(spark, f"file://{tmp_path}/k", ROWS, ["k"])
    keyed.insert(frame(spark, *OLD))
    assert keyed.insert(frame(spark, ("a", None, 9, "new"), ("d", None, 9, "new"))) == 1
    assert sorted((str(r.k), r.n) for r in keyed.read().collect()) == [("None", 3), ("a", 1), ("b", 2), ("d", 9)]
