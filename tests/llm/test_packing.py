import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing
from tidemark.llm.queries import op6_packing
from tests.llm.fixtures import empty, messy


def check(rows, pieces):
    """Every document's pieces and every sequence's places are as they must be."""
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces), key=str) == sorted(want, key=str)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(bins)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pieces = op6_packing(spark, sf_dir).collect()
    n = check(rows, pieces)
    assert n <= 1.02 * -(-sum(p.length for p in pieces) // 1024) + 1


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()] + [(11, "before <|endoftext|> after")]
    df = messy(spark).unionByName(spark.createDataFrame([rows[-1]], "doc_id long, text string"), allowMissingColumns=True)
    check(rows, packing.pack(df).collect())
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_packs_everything_tightly(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = rng.choice([rng.randint(1, 1024), rng.randint(1, 200), 513, 342])
        counts[n] = counts.get(n, 0) + 1
    patterns = packing.plan(dict(counts))
    total = {}
    for used, copies in patterns:
        assert sum(n * t for n, t in used.items()) <= 1024
        for n, t in used.items():
            total[n] = total.get(n, 0) + t * copies
    assert total == counts
    bins = sum(c for _, c in patterns)
    # First fit decreasing, one piece at a time, is no better.
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = next((i for i, g in enumerate(gaps) if g >= n), None)
        if i is None:
            gaps.append(1024 - n)
        else:
            gaps[i] -= n
    assert bins <= len(gaps) + 2


def test_two_fit_replaces_the_smallest():
    assert packing.plan({600: 1, 300: 1, 250: 1, 170: 1}) == [({600: 1, 250: 1, 170: 1}, 1), ({300: 1}, 1)]


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \n", "a", "1", "!", "\u3000", "漢"])
def test_long_runs_get_the_tokenizer_s_ids(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "before" + unit * 1_000_000 + "after it."
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder("byte_bpe_50k")(text).tolist() == full.encode(text, add_special_tokens=False).ids


def test_a_document_of_a_million_spaces(spark):
    rows = [(1, " " * 1_000_000), (2, "x" + "\n" * 1_200_000), (3, "short")]
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())
