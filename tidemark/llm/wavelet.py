"""Ranked lexical search over dual-sorted wavelet trees.

Each shard of the index holds a few thousand documents. Its postings lists, each in order of
falling impact, stand one after another as one sequence of document numbers, and a wavelet tree
over that sequence (a matrix of bit vectors with ranks) also keeps every list in order of
documents: a node stands for a stretch of document numbers, and a list's part in it is one range
whose first entry has the greatest impact there. The sum of those, weighted, over a query's terms
is a bound on every score in the node's stretch.

A search begins at the root and always opens the nodes of the greatest bounds next (the smallest
document first among equal ones), some dozens for each query at a time so that ranks are taken for
many nodes at once. A node's children are the intersections of the query's ranges with either
half of its documents; at a leaf the bound is the score. Nodes that can't beat the k-th
document found so far, also in the shards that the task has done before, are never opened, so
the k best are exact.

How it scales: texts are read twice and never moved; the first pass counts terms and documents,
the second builds shards inside its tasks. Queries come in blocks of bounded size, each sent to
all shards; their document frequencies are summed from the shards' dictionaries. What is shuffled
is k rows a query and task.

Defined results: a null text has no terms and is found by nothing. Items without terms, or
whose terms no document holds, have no rows. Rows with equal ids are documents of their own;
those without id come last among equal scores. Ids are integers. Repeated items get results each.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bound_batches, staged

#: How many documents, and about how many words, a shard holds at most (one long text may exceed the latter).
SHARD_DOCS, SHARD_WORDS = 4096, 1 << 20
#: Terms of a block of queries, queries searched side by side, and nodes of a query opened at a time.
BLOCK_TERMS, SIDE_BY_SIDE, OPENED = 200_000, 64, 64
BEST = 20
#: The score's constants: what a document's length adds to the normaliser, in percent.
LENGTH_PERCENT, SATURATION = 25, 12
_NO_ID = np.iinfo(np.int64).max

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all that isn't ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight, by the documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts_of(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term's occurrences count in documents of `length` terms, before its weight."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * length * documents) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


class WaveletTree:
    """Bit vectors of a sequence, level by level, zeros before ones, and impacts in each level's order."""

    def __init__(self, bits: np.ndarray, impacts: np.ndarray):
        n = len(impacts)
        self.depth, width = bits.shape
        # One word more, so that ranks may be asked for the end.
        self.words = np.zeros((self.depth, width + 1), np.uint64)
        self.words[:, :width] = bits
        self.before = np.zeros((self.depth, width + 1), np.int64)
        np.cumsum(np.bitwise_count(bits), axis=1, out=self.before[:, 1:])
        self.zeros = n - self.before[:, -1]
        self.impacts = np.empty((self.depth + 1, n), np.int32)
        self.impacts[0] = impacts
        for level in range(self.depth):
            one = np.unpackbits(bits[level].view(np.uint8), count=n, bitorder="little").astype(bool)
            own = self.impacts[level]
            self.impacts[level + 1] = np.concatenate([own[~one], own[one]])
        self.width, self.n = width + 1, n
        self.words, self.before, self.impacts = self.words.ravel(), self.before.ravel(), self.impacts.ravel()

    @staticmethod
    def bits_of(sequence: np.ndarray, depth: int) -> np.ndarray:
        """The bit vectors of a sequence of numbers under 2 ** depth, in words of 64."""
        width = -(-len(sequence) // 64)
        out = np.zeros((depth, width * 8), np.uint8)
        for level in range(depth):
            one = (sequence >> (depth - 1 - level)) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            out[level, : len(packed)] = packed
            sequence = np.concatenate([sequence[~one], sequence[one]])
        return out.view(np.uint64)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ones a level has before each place."""
        word = level * self.width + (at >> 6)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def first(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.impacts[level * self.n + at]


class Best:
    """The k best (score, id) of each query so far; equal scores go by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, _NO_ID)
        self.opened = 0

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        q, s, d = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, id]
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = rank == self.k - 1
        self.least[q[full]], self.last[q[full]] = s[full], d[full]
        kept = rank < self.k
        self.query, self.score, self.id = q[kept], s[kept], d[kept]

    def may_enter(self, query: np.ndarray, bound: np.ndarray, id: np.ndarray) -> np.ndarray:
        """Whether a document of at most that score and at least that id could be among the best."""
        least = self.least[query]
        return (bound > 0) & ((bound > least) | ((bound == least) & (id <= self.last[query])))


class _Nodes(NamedTuple):
    """Open nodes, and their ranges in order of the nodes: `many` ranges each."""

    query: np.ndarray
    level: np.ndarray
    prefix: np.ndarray
    bound: np.ndarray
    many: np.ndarray
    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray

    def taken(self, which: np.ndarray) -> _Nodes:
        ranges = np.repeat(which, self.many)
        return _Nodes(*(c[which] for c in self[:5]), *(c[ranges] for c in self[5:]))

    @staticmethod
    def joined(parts: list[_Nodes]) -> _Nodes:
        return _Nodes(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _smallest(nodes: _Nodes, ids: np.ndarray, depth: int) -> np.ndarray:
    """The smallest id that a node's stretch could hold."""
    return ids[np.minimum(nodes.prefix << (depth - nodes.level), len(ids) - 1)]


def _bounded(tree: WaveletTree, query, level, prefix, owner, start, end, weight) -> _Nodes:
    """Nodes with their bounds, without empty ranges and nodes that have none; `owner` rises."""
    there = end > start
    owner, start, end, weight = owner[there], start[there], end[there], weight[there]
    # Sums stay far below 2 ** 53, so they are exact.
    bound = np.bincount(owner, weights=weight * tree.first(level[owner], start).astype(np.float64), minlength=len(query)).astype(np.int64)
    many = np.bincount(owner, minlength=len(query))
    own = many > 0
    return _Nodes(query[own], level[own], prefix[own], bound[own], many[own], start, end, weight)


def _children(tree: WaveletTree, nodes: _Nodes) -> list[_Nodes]:
    owner = np.repeat(np.arange(len(nodes.query)), nodes.many)
    level = nodes.level[owner]
    one_start, one_end = tree.ones(level, nodes.start), tree.ones(level, nodes.end)
    zeros = tree.zeros[level]
    down = nodes.level + 1
    return [
        _bounded(tree, nodes.query, down, nodes.prefix * 2, owner, nodes.start - one_start, nodes.end - one_end, nodes.weight),
        _bounded(tree, nodes.query, down, nodes.prefix * 2 + 1, owner, zeros + one_start, zeros + one_end, nodes.weight),
    ]


def search_tree(tree: WaveletTree, ids: np.ndarray, query: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, best: Best, opened: int = OPENED) -> None:
    """Adds the shard's documents to `best`: ranges of the queries' terms, in order of the queries."""
    asked, owner = np.unique(query, return_inverse=True)
    zero = np.zeros(len(asked), np.int64)
    front = _bounded(tree, asked, zero, zero, owner, start, end, weight)
    while True:
        low = _smallest(front, ids, tree.depth)
        front = front.taken(best.may_enter(front.query, front.bound, low))
        if not len(front.query):
            return
        # The best nodes of each query.
        order = np.lexsort((_smallest(front, ids, tree.depth), -front.bound, front.query))
        q = front.query[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        now = np.zeros(len(q), bool)
        now[order] = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < opened
        best.opened += int(now.sum())
        born = _Nodes.joined(_children(tree, front.taken(now)))
        done = born.level == tree.depth
        if done.any():
            leaves = born.taken(done)
            best.add(leaves.query, leaves.bound, ids[leaves.prefix])
            born = born.taken(~done)
        front = _Nodes.joined([front.taken(~now), born])


class Index(NamedTuple):
    """Shards (ids, terms, starts, impacts, bits; a row each) and the corpus' counts."""

    shards: DataFrame
    documents: int
    total: int


_SHARD = "ids binary, terms binary, starts binary, impacts binary, bits binary"


def built(docs: list[tuple[int, Counter, int]], documents: int, total: int) -> tuple[bytes, ...]:
    """A shard's row from (id, counts of terms, number of terms) of its documents."""
    docs.sort(key=lambda d: d[0])
    numbers: dict[bytes, int] = {}
    term = np.concatenate([np.fromiter((numbers.setdefault(t, len(numbers)) for t in c), np.int64, len(c)) for _, c, _ in docs])
    tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c, _ in docs])
    doc = np.repeat(np.arange(len(docs)), [len(c) for _, c, _ in docs])
    impact = impacts_of(tf, np.array([n for *_, n in docs], np.int64)[doc], documents, total)
    names = sorted(numbers)
    place = np.empty(len(names), np.int64)
    place[[numbers[t] for t in names]] = np.arange(len(names))
    term = place[term]
    order = np.lexsort((doc, -impact, term))
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))
    depth = max(1, (len(docs) - 1).bit_length())
    bits = WaveletTree.bits_of(doc[order], depth)
    ids = np.array([d[0] for d in docs], np.int64)
    return ids.tobytes(), b" ".join(names), starts.astype(np.int32).tobytes(), impact[order].astype(np.int32).tobytes(), bits.tobytes()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> Index:
    """The index of all documents, staged in the shared folder."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def count(batches):
        documents = total = 0
        for batch in batches:
            lengths = [len(terms_of(t)) for t in _texts(batch, "text")]
            documents, total = documents + sum(n > 0 for n in lengths), total + sum(lengths)
        yield pa.RecordBatch.from_pydict({"documents": pa.array([documents], pa.int64()), "total": pa.array([total], pa.int64())})

    counts = rows.select("text").mapInArrow(count, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = counts[0] or 0, counts[1] or 0
    names = [c.split()[0] for c in _SHARD.split(", ")]

    def build(batches):
        own, words = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch, "text"), strict=True):
                terms = terms_of(t)
                if terms:
                    own.append((_NO_ID if i is None else i, Counter(terms), len(terms)))
                    words += len(terms)
                if len(own) == shard_docs or words >= shard_words:
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in built(own, documents, total)], names=names)
                    own, words = [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in built(own, documents, total)], names=names)

    return Index(staged(rows.mapInArrow(build, _SHARD), "wavelet"), documents, total)


def _blocks(queries: DataFrame, id: str, text: str, most: int):
    """The queries, numbered, in blocks of about `most` different terms of a query, never all at once."""
    block, size = [], 0
    for number, row in enumerate(queries.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator()):
        terms = Counter(terms_of(None if row.t is None else row.t.encode("utf-8", "surrogatepass")))
        if terms:
            block.append((number, row.i, terms))
            size += len(terms)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _holding(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of a block's terms: sums of the lengths of their lists."""
    shared = shards.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches):
        asked, held = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for names, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = np.diff(np.frombuffer(starts, np.int32))
                for at, name in enumerate(names.split(b" ")):
                    number = asked.get(name)
                    if number is not None:
                        held[number] += lengths[at]
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"number": found, "holding": held[found]})

    sums = shards.select("terms", "starts").mapInArrow(run, "number long, holding long").groupBy("number").agg(F.sum("holding").alias("holding")).toArrow()
    shared.destroy()
    return {terms[n]: h for n, h in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True)}


def _search_block(index: Index, block: list[tuple], k: int, opened: int) -> DataFrame:
    spark = index.shards.sparkSession
    holding = _holding(index.shards, sorted({t for *_, terms in block for t in terms}))
    heavy = {t: weight(index.documents, h) for t, h in holding.items()}
    # Terms without weight add nothing; a term's occurrences in the query multiply it.
    asked: dict[bytes, list[tuple[int, int]]] = {}
    for q, (*_, terms) in enumerate(block):
        for t, times in terms.items():
            if heavy.get(t, 0) > 0:
                asked.setdefault(t, []).append((q, heavy[t] * times))
    shared = spark.sparkContext.broadcast((asked, [n for n, *_ in block]))

    def run(batches):
        asked, numbers = shared.value
        groups = [Best(len(numbers), k) for _ in range(0, len(numbers), SIDE_BY_SIDE)]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, names, starts, impacts, bits = (c[row].as_py() for c in batch.columns)
                ids, starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int32)
                lists = [(q, starts[at], starts[at + 1], w) for at, name in enumerate(names.split(b" ")) if name in asked for q, w in asked[name]]
                if not lists:
                    continue
                q, start, end, w = np.array(sorted(lists), np.int64).T
                depth = max(1, (len(ids) - 1).bit_length())
                tree = WaveletTree(np.frombuffer(bits, np.uint64).reshape(depth, -1), np.frombuffer(impacts, np.int32))
                for g, best in enumerate(groups):
                    own = slice(*np.searchsorted(q, [g * SIDE_BY_SIDE, (g + 1) * SIDE_BY_SIDE]))
                    if own.stop > own.start:
                        search_tree(tree, ids, q[own], start[own], end[own], w[own], best, opened)
        for best in groups:
            yield pa.RecordBatch.from_pydict({"number": np.array(numbers, np.int64)[best.query], "doc": pa.array(best.id, pa.int64(), mask=best.id == _NO_ID), "score": best.score})

    return index.shards.mapInArrow(run, "number long, doc long, score long")


def search(index: Index, queries: DataFrame, k: int = BEST, id: str = "item_id", text: str = "text", doc_id: str = "doc_id", opened: int = OPENED, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(id, rank, doc_id, score): the k documents of the highest scores above 0 for each query."""
    spark = queries.sparkSession
    bound_batches(spark)
    out = None
    for block in _blocks(queries, id, text, block_terms):
        found = _search_block(index, block, k, opened)
        w = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        # At most k rows a query and task.
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        known = spark.createDataFrame([(n, i) for n, i, _ in block], T.StructType([T.StructField("number", T.LongType()), T.StructField(id, queries.schema[id].dataType)]))
        part = ranked.join(F.broadcast(known), "number").select(id, "rank", F.col("doc").alias(doc_id), "score")  # one row a query of the block
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([queries.schema[id], T.StructField("rank", T.IntegerType()), T.StructField(doc_id, T.LongType()), T.StructField("score", T.LongType())]))
    return out
