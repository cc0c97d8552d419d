import hashlib
import random
import re
import tracemalloc

import pytest

from tidemark.llm import decontam
from tidemark.llm.queries import op1_decontamination
from tests.llm.fixtures import empty, messy

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit[k : k + n] = [True] * n
                    found |= wins[tuple(w[k : k + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_words", [7, 10**6])
def test_small_vocabulary_against_brute_force(spark, seed, block_words):
    rng = random.Random(seed)
    say = lambda n, v="abc": " ".join(rng.choice(v) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 5, 9, 12]))) for i in range(8)] + [(3, say(4)), (None, say(6)), (99, None)]
    docs = [(d, say(rng.choice([0, 2, 10, 40]), "abcd")) for d in range(60)]
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, block_words=block_words)
    assert found(got) == brute(docs, items, 5)


def test_query_against_brute_force(spark, sf_dir):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("item_id", "text"))).collect()]
    assert found(op1_decontamination(spark, sf_dir)) == brute(read("documents"), read("benchmark"))


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "two three"), (2, None), (3, "!!")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()]
    assert found(decontam.find(messy(spark), items)) == brute(rows, [(1, "two three"), (2, None), (3, "!!")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.find(messy(spark), none).collect())
    assert decontam.find(empty(spark), items).count() == 0


def test_filter_cuts_spans_and_keeps_columns(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Some words first. Alpha, BETA gamma! And then some more words.", "x"), (2, "alpha beta gamma", "y"), (3, "clean", "z"), (4, None, "w")], "doc_id long, text string, n_words string")
    out = {r.doc_id: r for r in decontam.decontaminate(docs, items).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == "Some words first. ! And then some more words." and out[1].n_words == "x"
    assert out[3].text == "clean" and out[4].text is None


def test_blocks_and_automaton_have_bounds(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    items = spark.createDataFrame([(1, long), (2, "a b c"), (3, long[:5000])], "item_id long, text string")
    blocks = list(decontam.blocks_of(items, "item_id", "text", 10, 4000))
    assert max(sum(len(w) for _, w in b) for b in blocks) <= 4000
    w = words(long)
    assert {tuple(w[i : i + 10]) for i in range(len(w) - 9)} == {tuple(x.decode() for x in p[i : i + 10]) for b in blocks for name, p in b if name == "1" for i in range(len(p) - 9)}
    tracemalloc.start()
    made = decontam.automaton([("1", [x.encode() for x in w])], 10)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size <= 160 * len(w) and made.scan([x.encode() for x in w[500:520]])[0] == [(0, 20)]
