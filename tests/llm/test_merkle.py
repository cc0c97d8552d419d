import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import LEAF, op12_merkle_manifest
from tests.llm.fixtures import empty, messy


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, arity):
    """(root, the siblings of each leaf by level)"""
    level, at, found = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for n, i in enumerate(at):
            run = range(i // arity * arity, min(len(level), i // arity * arity + arity))
            found[n] += [level[k] for k in run if k != i]
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], found


def brute(rows, arity=2):
    """{leaf: (subroot, root, digest of siblings)}, rows being (group, key, leaf)."""
    groups = {}
    for group, key, digest in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, digest))
    order = sorted(groups, key=lambda g: (g is not None, str(g or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g])], arity) for g in order}
    root, above = tree([own[g][0] for g in order], arity)
    return sorted((x[2], own[g][0], root, h(*own[g][1][n], *above[i])) for i, g in enumerate(order) for n, x in enumerate(sorted(groups[g])))


def got(found):
    return sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in merkle.proven(found).collect())


@pytest.mark.parametrize("arity,height", [(2, 1), (2, 3), (3, 2), (5, 1), (2, 12)])
def test_trees_of_all_sizes(spark, arity, height):
    rng = random.Random(arity * 10 + height)
    rows = [(g, rng.choice([None, rng.randint(0, 10**6), 7]), f"text {rng.randint(0, 300)}") for g, n in (("a", 1), ("b", 2), ("é", 9), ("z", 130), (None, 33), ("", 5), ("bb", 8)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    found = merkle.manifest(df, ["k", "t"], "g", "k", arity=arity, height=height)
    assert got(found) == brute([(g, k, leaf([k, t])) for g, k, t in rows], arity)
    assert all(r.verified for r in merkle.proven(found).collect())


def test_many_groups(spark):
    rows = [(f"g{i % 97}", i, "x") for i in range(300)]
    found = merkle.manifest(spark.createDataFrame(rows, "g string, k long, t string"), ["k", "t"], "g", "k", height=2)
    assert got(found) == brute([(g, k, leaf([k, t])) for g, k, t in rows])


def test_odd_rows(spark):
    docs = messy(spark)
    assert got(merkle.manifest(docs, ["doc_id", "text"], "size", "doc_id")) == brute([(r["size"], r.doc_id, leaf([r.doc_id, r.text])) for r in docs.collect()])
    assert merkle.proven(merkle.manifest(empty(spark), ["doc_id", "text"], "size", "doc_id")).count() == 0


def test_one_group_of_equal_rows_is_divided(spark):
    """Rows that are equal in all stay leaves of their own, over several tasks."""
    df = spark.range(5000, numPartitions=7).select(F.lit("g").alias("g"), F.lit(1).cast("long").alias("k"), F.lit("t").alias("t"))
    assert got(merkle.manifest(df, ["k", "t"], "g", "k", height=4)) == brute([("g", 1, leaf([1, "t"]))] * 5000)
    tasks = merkle.numbered(df.select(F.col("g").alias("grp"), "k"), "k").select("at", "size").collect()
    assert sorted(r.at for r in tasks) == list(range(5000)) and {r.size for r in tasks} == {5000}


def test_parents_are_made_when_whole_and_the_rest_is_the_frontier():
    c = merkle.Combiner(3, 4)
    # Ten leaves: runs of 3, 3, 3 and 1, then 3 and 1, then 2.
    out = [c.add("g", 10, 0, i, f"{i}") for i in (4, 9, 3, 0, 5, 2, 1, 7, 8)]
    assert out == [None] * 9
    left = sorted(c.frontier())
    assert [(r[2], r[3]) for r in left] == [(0, 7), (0, 8), (1, 0), (1, 1), (2, 1)]
    root = c.add("g", 10, 0, 6, "6")
    assert root[4] == tree([f"{i}" for i in range(10)], 3)[0] and root[2:4] == (3, 0) and not list(c.frontier())


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*LEAF).collect()]
    out = op12_merkle_manifest(spark, sf_dir).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in out) == brute([(d[2], d[0], leaf(d)) for d in docs])
    changed = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None}
    assert changed and {r.doc_id for r in out if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in out)
