"""Indexes and embeddings that are kept up to date give what making them anew gives, for less work."""

import random
import re

import pytest

from tidemark import schemas
from tidemark.operators import embed, search
from tidemark.operators.segments import SegmentedIndex
from tidemark.plans.state import VersionedTable

WORDS = "apple banana cherry date elder fig grape hazel running runs".split()


def rebuilt(spark, texts, query):
    rows = spark.createDataFrame([(i, t) for i, t in texts.items() if t is not None], "id string, text string")
    made = search.postings(rows, "id", "text")
    return sorted((r.id, round(r.bm25, 9)) for r in search.bm25(made, search.corpus_stats(made, "id"), query, "id").collect())


def test_search_after_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", parts=8, buckets=2)
    assert index.search("apple").count() == 0
    texts = {}
    for step in range(3):
        batch = {f"t{rng.randrange(12)}": rng.choice([None, "", "  .,", *[" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(9)]]) if step else " ".join(rng.choices(WORDS, k=6)) for _ in range(14)}
        texts |= batch
        index.update(spark.createDataFrame([*batch.items(), (None, "apple apple")], "id string, text string"))
        if step == 1:
            index.merge()
            index.vacuum()
            assert index._segments().select("segment").distinct().count() == 1
        assert sorted((r.id, round(r.bm25, 9)) for r in index.search("apples running fig nowhere", 100).collect()) == rebuilt(spark, texts, "apples running fig nowhere")
    lengths = [len(t.split()) for t in texts.values() if t and t.strip(" .,")]
    stats = index.stats().first()
    assert stats.n_docs == len(lengths) and abs(stats.avgdl - sum(lengths) / len(lengths)) < 1e-9
    # A segment whose update never came to its commit counts for nothing.
    before = index.search("apple", 100).collect()
    index._write(search.postings(spark.createDataFrame([("t1", "apple " * 9)], "id string, text string"), "id", "text"), "lost")
    assert index.search("apple", 100).collect() == before
    # The folders of the query's terms only are read.
    plan = index.postings(["fig"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+", plan)


def test_a_text_has_a_row_for_each_part(spark, tmp_path):
    texts = {f"t{i}": " ".join(f"w{i * j % 97}" for j in range(200)) for i in range(1, 9)}
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", parts=4, buckets=2, stem=False)
    index.update(spark.createDataFrame([*texts.items()], "id string, text string"))
    for rows in (8, 9):
        want = {(t, i, c.count(t), len(c)) for i, c in ((i, text.split()) for i, text in texts.items()) for t in c}
        got = [tuple(r) for r in index.postings().collect()]
        assert len(got) == len(want) and set(got) == want
        # Not a row a term: what is moved and ordered grows with the texts' parts.
        assert spark.read.parquet(f"{tmp_path}/index/segments").count() <= rows * 4
        # Of rows that share an id the first by text counts.
        texts["t1"] = "b c b"
        index.update(spark.createDataFrame([("t1", "z"), ("t1", None), ("t1", "b c b")], "id string, text string"))
    index.merge()
    index.vacuum()
    assert {tuple(r) for r in index.postings(["b"]).collect()} == {("b", "t1", 2, 3)}


class Counting:
    """Lengths as vectors; every call and its texts go into a file."""

    model = "count"

    def __init__(self, path, fail=0):
        self.path, self.fail = str(path), fail

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write(f"{len(texts)} {sum(map(len, texts))}\n")
        with open(self.path) as f:
            if len(f.readlines()) <= self.fail:
                raise RuntimeError("busy")
        return [[float(len(t)), 1.0] for t in texts]


def test_only_stale_texts_are_embedded(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/e", schemas.EMBEDDINGS, schemas.KEYS["embeddings"], buckets=2)
    model = Counting(tmp_path / "calls")

    def run(rows, **bounds):
        (tmp_path / "calls").write_text("")
        embed.embed_stale(spark.createDataFrame(rows, "target_type string, target_id long, text string").coalesce(1), table, model, **bounds)
        calls = [tuple(map(int, line.split())) for line in (tmp_path / "calls").read_text().splitlines()]
        assert all(n <= bounds.get("batch_rows", 100) and (n == 1 or size <= bounds.get("batch_bytes", 1 << 20)) for n, size in calls)
        return sum(n for n, _ in calls)

    rows = [("event", i, "x" * (i + 1)) for i in range(30)] + [("event", 99, None), ("event", 98, "  "), ("entity", 3, "same id")]
    assert run(rows, batch_rows=7, batch_bytes=60) == 31
    assert run(rows) == 0
    rows[4] = ("event", 4, "another text")
    assert run([*rows, ("event", 200, "new"), ("event", 200, "new")]) == 2
    got = {(r.target_type, r.target_id): r.embedding for r in table.read().collect()}
    assert len(got) == 32 and got["event", "4"] == [12.0, 1.0] and got["event", "29"] == [30.0, 1.0]


def test_failed_calls_are_made_again(spark, tmp_path):
    rows = spark.createDataFrame([("event", 1, "x", "h")], "target_type string, target_id long, text string, source_text_hash string")
    (tmp_path / "a").write_text(""), (tmp_path / "b").write_text("")
    assert embed.embedded(rows, Counting(tmp_path / "a", fail=2), pause_seconds=0.01).first().embedding == [1.0, 1.0]
    with pytest.raises(Exception, match="busy"):
        embed.embedded(rows, Counting(tmp_path / "b", fail=99), tries=2, pause_seconds=0.01).collect()


@pytest.mark.parametrize("rows,size,want", [(3, 100, [(0, 3), (3, 5)]), (9, 5, [(0, 2), (2, 3), (3, 4), (4, 5)]), (1, 1, [(i, i + 1) for i in range(5)])])
def test_batches_are_bounded(rows, size, want):
    assert list(embed.batches_of(["ab", "cd", "éé", "longer than that", ""], rows, size)) == want
    assert list(embed.batches_of([], rows, size)) == []
