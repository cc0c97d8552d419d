"""Best-two-fit packing of tokenised documents into sequences.

Lengths are integers up to the sequence length, so the whole packing problem is a histogram:
at most `length` counts, however many documents there are. Only that histogram comes to the
driver. A bin is filled greedily (longest length that fits, again and again); if a gap remains,
the bin's smallest document is replaced by the two unpacked ones that fit the widened gap
most tightly. The same bin would be made again until one of its lengths runs out, so each
pattern is made as often as the counts allow in one step. Pieces then get a number within
their length (from their number within a staged block of rows), and pattern, copy and place
follow by arithmetic from it. No bin, pattern or piece list is ever gathered.

Defined results: a null text is an empty one, whose only token is the closing id. Repeated
rows are packed like any other rows. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import bound_batches, halved, staged, strings

LENGTH = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"


def _paths(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Token ids of the tokenizer file `<name>.json`.

    Where a rank file of the same vocabulary stands beside it, that is used for speed. Texts with
    the string of a special token go to the tokenizer itself, which gives its id, and so do those
    whose runs of white space are too long for the fast matcher.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        own, ranks = _paths(name)
        self.own, self.full = own, None  # the tokenizer itself is seldom needed, and large
        with open(own, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text).astype(np.uint32)
            except ValueError:  # the matcher's stack ran over
                pass
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.own)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    head = n % length or min(n, length)
    return [(0, head)] + [(s, length) for s in range(head, n, length)]


def pieces(docs: DataFrame, id: str, text: str, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, nth): nth numbers the pieces of the
    same length within a block, the rows of one task."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode = encoder(tokenizer)
        block, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for part in halved(batch):
                rows, out = [], []
                for i, t in enumerate(strings(part, "text")):
                    ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
                    for k, (start, n) in enumerate(cut(len(ids), length)):
                        rows.append(i)
                        out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes()), block, seen[n]))
                        seen[n] += 1
                cols = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:4]), pa.array(cols[4].astype(np.int32)), pa.array(cols[5])], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long")


#: Gaps up to which a bin is left as greedy filling made it; of the plans for each, the shortest counts.
LEFT_GAPS = (0, 2, 8, 32, 128, 512, LENGTH)


def plan(counts: dict[int, int], length: int = LENGTH, left_gaps: tuple[int, ...] = LEFT_GAPS) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, copies) that pack `counts` pieces of each length.

    Replacing for a small gain uses up the small pieces that later bins need, so the plan is made
    for several least gains and the one with the fewest bins is taken.
    """
    best, fewest, least = [], None, -(-sum(n * c for n, c in counts.items()) // length)
    for left in left_gaps:
        found = _plan(counts, length, left)
        bins = sum(copies for _, copies in found)
        if fewest is None or bins < fewest:
            best, fewest = found, bins
        if bins == least:
            break
    return best


def _plan(counts: dict[int, int], length: int, left_gap: int) -> list[tuple[dict[int, int], int]]:
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while (have := np.flatnonzero(left)).size:
        used: dict[int, int] = {}
        gap = length
        while gap:
            fit = have[: np.searchsorted(have, gap, side="right")][::-1]
            fit = next((int(n) for n in fit if left[n] > used.get(int(n), 0)), 0)
            if not fit:
                break
            # All that this length gives at once: it stays the longest that fits.
            times = min(gap // fit, int(left[fit]) - used.get(fit, 0))
            used[fit] = used.get(fit, 0) + times
            gap -= times * fit
        if gap > left_gap:
            least = min(used)
            rest = left.copy()
            for n, t in used.items():
                rest[n] -= t
            pair = _two(rest, least, least + gap)
            if pair:
                used[least] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                used = {n: t for n, t in used.items() if t}
        copies = min(int(left[n]) // t for n, t in used.items())
        for n, t in used.items():
            left[n] -= copies * t
        out.append((used, copies))
    return out


def _two(rest: np.ndarray, least: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum over `least` and up to `room`."""
    have = np.flatnonzero(rest[: room + 1])
    best, pair = least, None
    for a in have[::-1].tolist():
        if 2 * a <= best:  # the other is no longer than a
            break
        b = have[: np.searchsorted(have, min(room - a, a), side="right")]
        if b.size and b[-1] == a and rest[a] < 2:
            b = b[:-1]
        if b.size and a + int(b[-1]) > best:
            best, pair = a + int(b[-1]), (a, int(b[-1]))
            if best == room:
                break
    return pair


def layout(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, which of its pieces (by number, from `base`) go to which pattern."""
    rows, base, sequence = [], {}, 0
    for used, copies in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, base.get(n, 0), used[n], sequence, offset))
            base[n] = base.get(n, 0) + used[n] * copies
            offset += n * used[n]
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "base", "times", "sequence", "offset"]).sort_values(["length", "base"], ignore_index=True)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = staged(pieces(docs, id, text, tokenizer, length, end_id), "pieces")
    blocks = rows.groupBy("block", "length").agg(F.count("*").alias("n"))
    # One row a block and length: a running sum over the blocks of each length.
    blocks = staged(blocks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")), "blocks")
    counts = {r.length: r.n for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # up to `length` rows
    table = layout(plan(counts, length))
    shared = rows.sparkSession.sparkContext.broadcast((table["length"].to_numpy() * (1 << 44) + table["base"].to_numpy(), table))
    # The blocks' table grows with the documents: both sides are dealt out by block, none is broadcast.
    numbered = rows.join(blocks.select("block", "length", "before").hint("shuffle_merge"), ["block", "length"])
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        keys, t = shared.value
        base, times, sequence, offset = (t[c].to_numpy() for c in ("base", "times", "sequence", "offset"))
        for b in batches:
            n = b["length"].to_numpy()
            rank = b["nth"].to_numpy() + b["before"].to_numpy()
            at = np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1
            own = rank - base[at]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], pa.array(sequence[at] + own // times[at]), pa.array(offset[at] + own % times[at] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc_id", id)
