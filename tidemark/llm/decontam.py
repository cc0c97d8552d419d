"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark's words become the automaton of all substrings of all items. Each document's
words are streamed through it; the longest match that ends at each word is known at every
step, so a word lies in a contaminated span as soon as that match reaches the window.

Defined results: a null or wordless text has no words and no hits. Null, empty and wordless
items match nothing. Equal items each count. Items without an id mark words, but are not
listed. Rows are mapped one by one, so repeated rows give repeated results. An empty
benchmark leaves every document clean. Columns of the input that have the name of an output
column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import map_arrow, put_aside, restored, staged, strings

WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of one automaton (about 150 bytes each, vocabulary included); a larger benchmark takes several passes, each with a block of it.
BLOCK_WORDS = 500_000

#: Lower-cases A-Z and makes every other ASCII byte that isn't a letter or digit a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised over several word sequences; `scan` finds where windows of them occur.

    States are numbers into flat arrays. A state's first transition is there as well, as most
    states have no other; only those that branch have a dictionary of the further ones.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.word, self.target = array("i", [-1]), array("i", [0])
        self.further: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list = []
        self.sequences: list[array] = []

    def add(self, item, words: list[bytes]) -> None:
        ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words])
        if ids:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            self.names.append(item)
            self.sequences.append(ids)

    def _next(self, state: int, c: int) -> int:
        """The state that word `c` leads to, or -1."""
        if self.word[state] == c:
            return self.target[state]
        more = self.further.get(state)
        return -1 if more is None else more.get(c, -1)

    def _point(self, state: int, c: int, target: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.target[state] = c, target
        else:
            self.further.setdefault(state, {})[c] = target

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.target.append(0)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._next(p, c)) < 0:
            self._point(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q])
        self.word[new], self.target[new] = self.word[q], self.target[q]
        if q in self.further:
            self.further[new] = dict(self.further[q])
        self.link[q] = new
        while p >= 0 and self._next(p, c) == q:
            self._point(p, c, new)
            p = self.link[p]
        return new

    def finish(self) -> SuffixAutomaton:
        """Note at each state the items whose window it stands for."""
        n, w, link, length = len(self.link), self.window, self.link, self.length
        order = np.argsort(np.frombuffer(length, np.int32), kind="stable")[1:]
        self.whole = whole = array("i", bytes(4 * n))  # the suffix state that holds the last `window` words
        whole[0] = -1
        for s in map(int, order):
            up = link[s]
            whole[s] = whole[up] if length[up] >= w else s if length[s] >= w else -1
        self.item = array("i", b"\xff" * (4 * n))  # the first item of a state, and those that follow
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, ids in enumerate(self.sequences):
            s = 0
            for i, c in enumerate(ids):
                s = self._next(s, c)
                if i + 1 >= w:
                    at = whole[s]
                    if self.item[at] < 0:
                        self.item[at] = number
                    elif self.item[at] != number:
                        self.items.setdefault(at, set()).add(number)
            if len(ids) < w:
                self.short.setdefault(s, []).append((len(ids), number))
        self.nearest = nearest = array("i", bytes(4 * n))
        nearest[0] = -1
        for s in map(int, order):
            nearest[s] = s if s in self.short else nearest[link[s]]
        self.least = min((min(len(ids), w) for ids in self.sequences), default=0)
        self.sequences = []
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word intervals (end exclusive) inside windows, and the items they are of."""
        if not self.least or len(words) < self.least:
            return [], set()
        word, target, further = self.word, self.target, self.further
        link, length, nearest, w = self.link, self.length, self.nearest, self.window
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        s = n = 0
        for i, c in enumerate(map(self.vocab.get, words), 1):
            if c is None:
                s = n = 0
                continue
            while word[s] != c and (s not in further or c not in further[s]):
                s = link[s]
                if s < 0:
                    break
                n = length[s]
            if s < 0:
                s = n = 0
                continue
            s = target[s] if word[s] == c else further[s][c]
            n += 1
            if n >= w:
                found.append((i - w, i))
                seen.add(self.whole[s])
            a = nearest[s]
            while a > 0:
                for m, item in self.short[a]:
                    if m <= n:
                        found.append((i - m, i))
                        items.add(item)
                a = nearest[link[a]]
        for state in seen:
            items.add(self.item[state])
            items |= self.items.get(state, set())
        return merged(found), {self.names[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """The benchmark's items in blocks of bounded size, never all of it at once.

    A longer item is cut into parts that share window - 1 words, so that no window is lost.
    """
    most = max(block_words, window)
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row.t)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            part = words[at : at + most]
            if part:
                if block and size + len(part) > block_words:
                    yield block
                    block, size = [], 0
                block.append((None if row.i is None else str(row.i), part))
                size += len(part)
    yield block


def automaton(block: list[tuple], window: int) -> SuffixAutomaton:
    made = SuffixAutomaton(window)
    for item, words in block:
        made.add(item, words)
    return made.finish()


_STATE = [("_hits", T.ArrayType(T.IntegerType())), ("_items", T.ArrayType(T.StringType()))]
_FOUND = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("clean_text", T.StringType())]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least_span: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated and clean_text.

    clean_text is the text without the hit spans of `least_span` words or more (null for
    a null text). A benchmark beyond `block_words` words is taken block by block; the words
    hit so far travel with the rows, which are staged between blocks.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.drop(*[n for n, _ in _FOUND], *[n for n, _ in _STATE])
    blocks = blocks_of(benchmark, item_id, item_text, window, block_words)
    block = next(blocks)
    first = True
    while block is not None:
        # Built here once; a broadcast leaves the workers when they go on to other work.
        shared = sc.broadcast(automaton(block, window))
        block = next(blocks, None)
        last, began = block is None, first

        def make(shared=shared, last=last, began=began):
            scan = shared.value.scan

            def compute(batch):
                rows = []
                texts = strings(batch, text)
                before = [(None, None)] * len(texts) if began else list(zip(strings(batch, "_hits"), strings(batch, "_items"), strict=True))
                for t, (hits, items) in zip(texts, before, strict=True):
                    words = words_of(t)
                    spans, got = scan(words)
                    if hits:
                        spans = merged(spans + list(zip(hits[::2], hits[1::2], strict=True)))
                    got = got | set(items or ())
                    rows.append(_result(t, len(words), spans, got, least_span) if last else ([x for s in spans for x in s], sorted(x for x in got if x is not None)))
                return list(zip(*rows, strict=True))

            return compute

        docs = map_arrow(docs, make, _FOUND if last else _STATE, [c for c in docs.columns if not (last and c in ("_hits", "_items"))])
        if not last:
            docs = staged(docs, "decontam")
        first = False
    return docs


def _result(text, n_words: int, spans, items: set, least_span: int):
    named = sorted(x for x in items if x is not None)
    digest = hashlib.sha256(",".join(named).encode()).hexdigest()
    clean = text
    cut = [(a, b) for a, b in spans if b - a >= least_span]
    if cut:
        at = [m.span() for m in WORD_ANY_CASE.finditer(text)]
        parts, done = [], 0
        for a, b in cut:
            parts.append(text[done : at[a][0]])
            done = at[b - 1][1]
        clean = "".join([*parts, text[done:]])
    return n_words, sum(b - a for a, b in spans), len(named), digest, bool(spans), clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, least_span: int = 1, most_coverage: float = 0.5, **names) -> DataFrame:
    """The filter: documents whose hit words exceed `most_coverage` of all go; from the others
    every hit span of `least_span` words or more is cut. Columns stay as they were."""
    found = find(put_aside(docs, text), benchmark, text, window=window, least_span=least_span, **names)
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= most_coverage * F.col("n_words")))
    return restored(found.withColumn(text, F.col("clean_text")), docs.columns, (text,))
