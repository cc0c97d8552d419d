import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import empty, messy
from tidemark.llm import wavelet
from tidemark.llm.queries import op13_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total, df = len(counts), sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op13_ranked_search(spark, sf_dir)) == brute(docs, items)


@pytest.mark.parametrize("shard_docs,opened,block_terms,k", [(1, 1, 1, 3), (7, 2, 10, 5), (64, 64, 100_000, 20), (4096, 3, 100_000, 1)])
def test_small_shards_ties_and_blocks(spark, shard_docs, opened, block_terms, k):
    rng = random.Random(shard_docs)
    words = [f"w{i}" for i in range(30)]
    docs = [(rng.choice([None, i, i, i, 3]), " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(30)], k=rng.randint(1, 12)))) for i in range(150)]
    docs += [(1000 + i, "w3 w9 w9") for i in range(60)] + [(5000, None), (5001, " .,; "), (5002, "W3 É é w9"), (5003, "w29")]
    items = [("a", "w9 w3 w3"), ("b", None), ("c", ""), ("a", "w0"), ("d", "nowhere"), ("e", "É w9 É"), (None, "w29 W29"), ("f", " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    made = wavelet.index(df, shard_docs=shard_docs)
    found = wavelet.search(made, spark.createDataFrame(items, "item_id string, text string"), k, opened=opened, block_terms=block_terms)
    assert got(found) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = messy(spark)
    items = [(1, "One two three and word5"), (2, "1" * 300_000), (3, "漢字 a@b.cc\x00end"), (4, None)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(wavelet.search(wavelet.index(docs), queries)) == brute(rows, items)
    assert wavelet.search(wavelet.index(empty(spark)), queries).count() == 0
    nothing = wavelet.search(wavelet.index(docs), queries.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranges_of_the_tree_follow_a_list_to_every_document():
    rng = np.random.default_rng(1)
    sequence = np.concatenate([rng.permutation(100)[:n] for n in (1, 100, 37, 5)])
    impacts = np.concatenate([np.sort(rng.integers(1, 50, n))[::-1] for n in (1, 100, 37, 5)]).astype(np.int32)
    tree = wavelet.WaveletTree(wavelet.WaveletTree.bits_of(sequence, 7), impacts)
    for a, b in ((0, 1), (1, 101), (101, 138), (138, 143), (0, 0)):
        work, leaves = [(0, 0, a, b)], {}
        while work:
            level, prefix, s, e = work.pop()
            own = [i for i in range(a, b) if sequence[i] >> (7 - level) == prefix]
            assert e - s == len(own)
            if not own:
                continue
            # The first of a range is the greatest, as the lists are in order of impact.
            assert tree.first(np.array([level]), np.array([s]))[0] == max(impacts[i] for i in own)
            if level == 7:
                leaves[prefix] = impacts[own[0]]
                continue
            ones = tree.ones(np.array([level, level]), np.array([s, e]))
            work += [(level + 1, prefix * 2, s - ones[0], e - ones[1]), (level + 1, prefix * 2 + 1, tree.zeros[level] + ones[0], tree.zeros[level] + ones[1])]
        assert leaves == {sequence[i]: impacts[i] for i in range(a, b)}


def test_bounds_keep_most_nodes_closed():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, (c := Counter(rng.choices(words, weights=[1 / (j + 1) for j in range(2000)], k=60))), c.total()) for i in range(4000)]
    total = sum(n for *_, n in docs)
    ids, names, starts, impacts, bits = wavelet.built([(i, Counter({t.encode(): n for t, n in c.items()}), m) for i, c, m in docs], 4000, total)
    ids, starts, names = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int32), names.split(b" ")
    tree = wavelet.WaveletTree(np.frombuffer(bits, np.uint64).reshape(12, -1), np.frombuffer(impacts, np.int32))
    asked = [b"w0", b"w1", b"w700", b"w1200"]
    at = [names.index(t) for t in asked]
    held = np.diff(starts)[at]
    weights = np.array([wavelet.weight(4000, int(h)) for h in held])
    best = wavelet.Best(1, 10)
    wavelet.search_tree(tree, ids, np.zeros(4, np.int64), starts[at].astype(np.int64), starts[np.array(at) + 1].astype(np.int64), weights, best, 8)
    # All nodes that hold a document with one of the words are thousands.
    assert len(best.id) == 10 and best.opened < 1500
    scores = {i: sum(w * int(wavelet.impacts_of(np.int64(c[t.decode()]), np.int64(m), 4000, total)) for t, w in zip(asked, weights.tolist(), strict=True) if t.decode() in c) for i, c, m in docs}
    want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert list(zip(best.id.tolist(), best.score.tolist(), strict=True)) == want
