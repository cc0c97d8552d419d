import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import _shared as shared
from tidemark.llm import simhash
from tidemark.llm.queries import op8_simhash
from tidemark.plans.components import components
from tests.llm.fixtures import empty, messy


def naive_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    a = np.array(fps, np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def expected(rows):
    fps = [naive_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    low = {}
    for (d, _), r in zip(rows, root):
        low.setdefault(r, []).append(d)
    low = {r: min((x for x in ds if x is not None), default=None) for r, ds in low.items()}
    return sorted(((d, f"{f:016x}", low[r]) for (d, _), f, r in zip(rows, fps, root)), key=str)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op8_simhash(spark, sf_dir).collect()), key=str) == expected(rows)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(messy(spark)).collect()), key=str) == expected(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(messy(spark))
    assert kept.columns == messy(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({low for _, _, low in expected(rows) if low is not None})


@pytest.mark.parametrize("most_in_ball", [3, 20, 4096])
def test_components_of_clusters_chains_and_strangers(spark, most_in_ball):
    rng = random.Random(most_in_ball)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {0}
    for _ in range(6):  # tight clusters and chains of three bits a step
        c = rng.getrandbits(64)
        fps |= {flip(c, rng.randrange(0, 6)) for _ in range(60)}
        for _ in range(12):
            fps.add(c := flip(c, 3))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    label = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, low long")
    got = {r.fp: r.low for r in simhash.components(simhash.near_links(label.select("fp"), most_in_ball=most_in_ball), label).collect()}
    root = brute_components(fps)
    assert all(got.get(s, i) == root[i] for i, s in enumerate(signed))


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = centre ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([near, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    for q in points[::50]:
        tree = simhash.VantageTree(points)
        assert sorted(tree.take(q, 3)) == np.flatnonzero(np.bitwise_count(points ^ q) <= 3).tolist()


def test_rows_without_or_with_the_same_id_stay_if_their_texts_differ(spark):
    a, b, c = (" ".join(f"{w}{i * i % 97}" for i in range(40)) for w in ("red", "green", "blue"))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, a + " " + b), (2, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, a), (None, b), (1, c), (1, a + " " + b)], key=str)


def test_balls_are_divided_until_none_is_overfull(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    # A hot ball: all agree in 40 bits; and strangers.
    fps = sorted({centre ^ rng.getrandbits(24) for _ in range(3000)} | {rng.getrandbits(64) for _ in range(500)})
    unique = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    sizes = simhash.balls(unique, most_in_ball=100).groupBy("mask", "value").count()
    masks = simhash.Masks(3)
    assert len(masks.children([0])) == 4 and masks.divisible(1)
    assert sizes.agg({"count": "max"}).first()[0] <= 2048
    asked = {(r.mask, r.value, r.fp) for r in simhash.balls(unique, most_in_ball=100).collect()}
    by = {}
    for mask, value, fp in asked:
        by.setdefault(fp, set()).add((mask, value))
    a = np.array(fps, np.uint64)
    for i in range(0, len(a), 7):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            assert by[int(a[i].astype(np.int64))] & by[int(a[j].astype(np.int64))]


def test_every_link_comes_from_a_tree(spark, sf_dir, monkeypatch):
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 6, 40, dtype=np.uint64) | np.uint64(k << 50) for k in range(30)]))
    value = (fps >> np.uint64(50)).astype(np.int64)
    order = np.argsort(value, kind="stable")
    a, b = simhash.ball_links([value[order]], fps[order])
    assert len(a) > 100
    monkeypatch.setattr(simhash.VantageTree, "take", lambda *_: simhash._NONE)
    assert not len(simhash.ball_links([value[order]], fps[order])[0])


def test_a_row_that_shares_its_id_with_a_copy_stays(spark):
    a, b = (" ".join(f"{w}{i * i % 97}" for i in range(40)) for w in ("red", "green"))
    rows = [(1, a), (5, a), (5, b)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, kept)) == [(1, a), (5, b)]


def test_links_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(12)
    fps = {0}
    for _ in range(8):
        c = rng.getrandbits(64)
        for _ in range(40):
            c ^= 1 << rng.randrange(64)
            fps.add(c)
    fps = [(int(np.uint64(f).astype(np.int64)),) for f in sorted(fps)]
    found = []
    for seed in range(3):
        rng.shuffle(fps)
        unique = spark.createDataFrame(fps, "fp long").repartition(seed + 1)
        found.append({tuple(r) for r in simhash.near_links(unique).collect()})
    assert found[0] == found[1] == found[2] and found[0]


def test_links_that_change_when_made_again_still_join(spark):
    """Each time they are made the links are turned round at random, as if a task had run again."""
    def turn(batches):
        for batch in batches:
            rows = batch.to_pandas()
            swap = np.random.default_rng().random(len(rows)) < 0.5
            rows.loc[swap, ["a", "b"]] = rows.loc[swap, ["b", "a"]].to_numpy()
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    turned = spark.range(0, 40).selectExpr("id AS a", "id + 1 AS b").mapInArrow(turn, "a long, b long")
    label = spark.range(0, 41).selectExpr("id AS fp", "id + 100 AS low")
    for _ in range(3):
        assert {r.low for r in simhash.components(turned, label).collect()} == {100}
        assert {r.component for r in components(turned, "a", "b").collect()} == {0}


def test_rows_made_from_one_row_are_told_apart(spark, tmp_path):
    a, b, c = (" ".join(f"{w}{i * i % 97}" for i in range(40)) for w in ("red", "green", "blue"))
    spark.createDataFrame([(1, [a, b]), (2, [a, c])], "doc_id long, texts array<string>").write.parquet(f"{tmp_path}/x")
    read = spark.read.parquet(f"{tmp_path}/x")
    for docs in (read.select("doc_id", F.explode("texts").alias("text")), read.selectExpr("doc_id", "explode(texts) AS text").where("text IS NOT NULL"), read.selectExpr("doc_id", "texts[0] AS text").union(read.selectExpr("doc_id", "texts[1] AS text"))):
        kept = simhash.one_of_each(docs)
        assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (1, b), (2, c)])
    # Plain scans aren't staged.
    assert shared._names_rows(read.where("doc_id > 0").select("doc_id")) and not shared._names_rows(read.where("rand() > 0.5")) and not shared._names_rows(read.select(F.explode("texts")))


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_similar(texts, kept):
    """Of two texts of similarity 0.8 or more one goes (nine of ten times at least, near that limit);
    what goes is like a text that isn't far from it; of equal texts one stays."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similarity(sets[a], sets[b]) >= 0.8]
    assert sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    assert not any(a in kept and b in kept for a, b in near if sets[a] == sets[b])
    linked = {a for a in ids for b in ids if a != b and similarity(sets[a], sets[b]) >= 0.7}
    assert set(ids) - kept <= linked


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_similar_texts_are_one_group(spark):
    rng = random.Random(32)
    texts, n = {}, 0
    for group in range(12):
        words = [f"w{group}x{rng.randrange(400)}" for _ in range(rng.choice([250, 300]))]
        # Few edits make near copies; many make texts of their own.
        for edits in (0, 0, 1, 2, 3, 60, 80):
            texts[n] = edited(rng, words, edits)
            n += 1
    hot = [f"h{rng.randrange(900)}" for _ in range(400)]
    for _ in range(150):
        texts[n] = edited(rng, hot, 4)
        n += 1
    texts |= {n: "", n + 1: None, n + 2: "short text", n + 3: "short text"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.one_of_similar(df).collect()}
    check_similar(texts, kept)
    # The smallest of each group stays, those of many edits as well.
    assert {7 * g for g in range(12)} <= kept and {7 * g + k for g in range(12) for k in (5, 6)} <= kept
    assert not kept & {7 * g + k for g in range(12) for k in (1, 2, 3, 4)} and len(kept & set(range(84, 234))) == 1
    assert simhash.one_of_similar(empty(spark)).count() == 0 and simhash.one_of_similar(messy(spark)).columns == messy(spark).columns


def test_links_of_a_ball_are_in_proportion_to_its_members():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 5), dtype=np.uint64), axis=1)
    points = np.unique(np.concatenate([centre ^ flips, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    a, b = simhash.candidate_links(points, 16)
    assert len(points) - 200 - 10 < len(a) < len(points)
    assert (np.bitwise_count(a ^ b) <= 16).all()
