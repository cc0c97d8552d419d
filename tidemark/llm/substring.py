"""Repeated passages: sliding spans of consecutive sentences, joined over the whole corpus.

A text is cut into sentences; from each sentence on, the shortest run of at least
`LEAST_SENTENCES` sentences and `LEAST_WORDS` words (or of `LONG_WORDS` words, however few
sentences) is a span and is hashed (128 bits, lower case, white space as one space). A span that
occurred before, in the same document or in an earlier one, is repeated; every sentence that a
repeated span covers is removed.

A sentence ends at . ! ? before white space, or at a line's end. Only run-on sentences, of more
than `RUN_ON` words, are cut further: after words picked by their own hash (about one in
`BREAK`) and after `MOST_WORDS` words. Such cuts depend on nearby words alone, so a passage that
was put into the middle of another sentence falls into step after a few words.

How it scales: spans are made once and staged, repeats within a document are found on the way.
One row a span is aggregated map-side to its least and greatest ids; the repeated hashes, a small
part, are staged and joined with the spans, a join that Spark splits at hot hashes. Texts move
once, with the numbers of the sentences to remove.

Defined results: a null text stays null. Documents are ordered by id, then by a hash of the text;
those without an id come last, by another hash of the text. Rows of equal id and text are one
document and get the same result; rows that share an id, or have none, and differ in text are
documents of their own. Ids that are no whole numbers are ordered by a hash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bound_batches, halved, map_arrow, staged, strings

LEAST_SENTENCES, LEAST_WORDS = 3, 20
#: Words from which fewer sentences make a span.
LONG_WORDS = 32
RUN_ON, BREAK, MOST_WORDS = 20, 8, 40
TOKEN = re.compile(r"\S+")
END = re.compile(r"(?<=[.!?])\s+|\n")
#: Order of documents without an id: from here on, by a hash.
NO_ID = 1 << 62


class _Breaks(dict):
    """Whether a run-on sentence is cut after a word, remembered for the words seen lately."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BREAK == 0
        return out


_breaks = _Breaks().__getitem__


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The sentences in normal form, and their numbers of words."""
    bodies, counts = [], []
    for sentence in END.split(text.lower()):
        words = sentence.split()
        begin = 0
        if len(words) > RUN_ON:
            for end, cut in enumerate(map(_breaks, words), 1):
                if cut or end - begin == MOST_WORDS:
                    bodies.append(" ".join(words[begin:end]))
                    counts.append(end - begin)
                    begin = end
        if begin < len(words):
            bodies.append(" ".join(words[begin:]))
            counts.append(len(words) - begin)
    return bodies, counts


def places(text: str, counts: list[int]) -> list[tuple[int, int]]:
    """Character spans of the sentences, each with the white space that follows it."""
    begins = [m.start() for m in TOKEN.finditer(text)]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    starts = [0, *(begins[i] for i in first[1:])]
    return list(zip(starts, [*starts[1:], len(text)], strict=True))


def runs(counts: list[int], least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> list[int]:
    """The end (exclusive) of the span from each sentence, 0 where the text ends before."""
    out, end, words = [], 0, 0
    for i in range(len(counts)):
        while end < len(counts) and (words < least_words or end - i < least_sentences and words < LONG_WORDS):
            words += counts[end]
            end += 1
        out.append(end if words >= least_words and (end - i >= least_sentences or words >= LONG_WORDS) else 0)
        words -= counts[i]
    return out


def _hashes(bodies: list[str], ends: list[int]) -> list[bytes]:
    encoded = [(b + " ").encode("utf-8", "surrogatepass") for b in bodies]
    joined = b"".join(encoded)
    at = [0, *np.cumsum([len(e) for e in encoded]).tolist()]
    return [xxhash.xxh3_128_digest(joined[at[i] : at[e]]) if e else b"" for i, e in enumerate(ends)]


_SPAN = "h1 long, h2 long, id long, copy long, at int"


def _spans(docs: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """(h1, h2, id, copy, at) of each document's spans; -1 - at for one seen in it before."""

    def run(batches):
        for batch in batches:
            for part in halved(batch):
                digests, ids, copies, at = [], [], [], []
                for d, c, t in zip(strings(part, "id"), strings(part, "copy"), strings(part, "text"), strict=True):
                    if not t:
                        continue
                    bodies, counts = sentences(t)
                    first: dict[bytes, int] = {}
                    before = len(at)
                    for i, h in enumerate(_hashes(bodies, runs(counts, least_sentences, least_words))):
                        if h:
                            digests.append(h)
                            at.append(i if first.setdefault(h, i) == i else -1 - i)
                    ids += [d] * (len(at) - before)
                    copies += [c] * (len(at) - before)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(at, pa.int32())], names=["h1", "h2", "id", "copy", "at"])

    return docs.mapInArrow(run, _SPAN)


def _later(spans: DataFrame) -> DataFrame:
    """(id, copy, at) of the spans that occurred before."""
    places = ["h1", "h2"]
    seen = spans.where("at >= 0").groupBy(*places).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("copy").alias("low"), F.max("copy").alias("high"))
    repeated = staged(seen.where("first < last OR low < high").select(*places, "first"), "repeated")
    found = staged(spans.where("at >= 0").join(repeated, places), "found")
    # Rows that share their id: of documents with the smallest one, the least copy comes first.
    least = found.where("id = first").groupBy(*places).agg(F.min("copy").alias("least"), F.max("copy").alias("most")).where("least < most")
    after = found.join(staged(least.drop("most"), "least"), places, "left").where("id > first OR copy > least")
    within = spans.where("at < 0").withColumn("at", -1 - F.col("at"))
    return after.select("id", "copy", "at").union(within.select("id", "copy", "at"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with n_removed, the sentences cut, and clean_text (trimmed at its ends if any were)."""
    bound_batches(docs.sparkSession)
    number = F.col(id).cast("long") if isinstance(docs.schema[id].dataType, T.IntegralType) else F.when(F.col(id).isNotNull(), F.shiftrightunsigned(F.xxhash64(id), 2))
    other = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(text)), 2) + F.lit(NO_ID)
    key = docs.withColumn("__id", F.coalesce(number, other)).withColumn("__copy", F.xxhash64(text))
    spans = staged(_spans(key.select(F.col("__id").alias("id"), F.col("__copy").alias("copy"), F.col(text).alias("text")), least_sentences, least_words), "spans")
    # Bounded by the sentences of a document.
    marks = staged(_later(spans).groupBy("id", "copy").agg(F.collect_set("at").alias("__at")), "marks")
    marked = key.join(marks.withColumnsRenamed({"id": "__id", "copy": "__copy"}), ["__id", "__copy"], "left").select(*docs.columns, "__at")

    def make():
        def compute(batch):
            out = [_cut(t, at, least_sentences, least_words) if at else (0, t) for t, at in zip(strings(batch, text), strings(batch, "__at"), strict=True)]
            return list(zip(*out, strict=True))

        return compute

    return map_arrow(marked, make, [("n_removed", T.LongType()), ("clean_text", T.StringType())], docs.columns)


def _cut(text: str, at: list[int], least_sentences: int, least_words: int) -> tuple[int, str]:
    _, counts = sentences(text)
    ends = runs(counts, least_sentences, least_words)
    gone = np.zeros(len(counts), bool)
    for i in at:
        gone[i : ends[i]] = True
    kept = "".join(text[a:b] for (a, b), g in zip(places(text, counts), gone, strict=True) if not g)
    return int(gone.sum()), kept.strip()
