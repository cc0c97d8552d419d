import zlib

import pytest

from tidemark.llm import sharding
from tidemark.llm.queries import op5_sharding
from tests.llm.fixtures import empty, messy


def check(rows, out, n=16):
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=key) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=key)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(n))
    for rs in shards.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sizes = [sum(r.size for r in shards.get(s, [])) for s in range(n)]
    most = max((r.size for r in out), default=0)
    assert all(abs(x - sum(sizes) / n) <= most for x in sizes)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = op5_sharding(spark, sf_dir).collect()
    check(rows, out)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_odd_rows(spark):
    check([(r.doc_id, r.text) for r in messy(spark).collect()], sharding.assign_shards(messy(spark)).collect())
    assert sharding.assign_shards(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [2, 16])
def test_hot_text_and_repeated_rows(spark, n):
    rows = [(7, "the very same row")] * 3000 + [(i, "the very same text") for i in range(3000)] + [(i, f"text {i} " * (i % 40)) for i in range(3000)]
    check(rows, sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n).collect(), n)


def test_ids_of_any_type_and_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(f"id{i}", "x" * i) for i in range(50)], "doc_id string, text string")
    check([(f"id{i}", "x" * i) for i in range(50)], sharding.assign_shards(docs, 4).collect(), 4)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


@pytest.mark.parametrize("draws", [0.001, 0.05, 1])
def test_overfull_ranges_are_cut_until_none_is(spark, monkeypatch, draws):
    monkeypatch.setattr(sharding, "DRAWS", draws)
    monkeypatch.setattr(sharding, "FULL", 1.1)
    rounds = []
    ranged = sharding._ranged
    monkeypatch.setattr(sharding, "_ranged", lambda keyed, splitters: (rounds.append(len(splitters)), ranged(keyed, splitters))[1])
    rows = [(7, "the very same row")] * 900 + [(i, f"text {i} " * (i % 40)) for i in range(900)] + [(i, "x" * 9000 * (i % 2)) for i in range(30)]
    check(rows, sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect(), 4)
    assert draws >= 1 or len(set(rounds)) >= 4
