"""Quality classifier: a factorisation machine over words, structure and metadata.

A text's features are its different words by hash, the bins that statistics of its structure
fall into, and what metadata say. The score is logistic in a bias, a weight for each feature and
the product of two short vectors for each pair of features; the sum over all pairs is taken as
half of (square of the sum less sum of squares), a factor at a time, in time linear in the
features. Weights and vectors are learned by adaptive gradient steps on the logistic loss.

The labelled rows learned from are a bounded sample: the first `LABELLED_ROWS` by a hash of their
ids, and no more of them than have `FIT_FEATURES` features together (whole texts all of them). So
the model has a fixed size, it is broadcast, and scoring is a map over whole texts.

Defined results: a null text is an empty one, and is scored. Rows without usable label, or with a
label of an unknown document, teach nothing; of several labels of one id the least counts. If no
label is left the score is 0.5, if all are equal it is near that label. Metadata that are null, or
that no labelled row had, have no effect.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import quality
from tidemark.llm._shared import map_arrow, staged, strings

LABELLED_ROWS, FIT_FEATURES = 8192, 4_000_000
#: Buckets of words, bins of a statistic, buckets of a metadata column's values.
WORDS, BINS, VALUES = 1 << 16, 16, 1 << 10
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 8, 64, 0.1, 1e-4, 29

STATISTICS = (*quality.FEATURES, "lines_again", "words_again", "same_again", "different", "marks", "size")


def structure(text: str, words: list[bytes]) -> list[float]:
    """Statistics of a text's structure, in the order of STATISTICS."""
    (n, chars, _, dup, repeat), rates = quality.statistics(text)
    lines = text.count("\n") + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = sum(text.count(c) for c in "!?.,;:")
    return [*rates, dup / lines, repeat / max(1, n), same / max(1, n), len(set(words)) / max(1, n), marks / max(1, chars), math.log2(1 + n)]


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words, and the buckets of the different ones in order."""
    words = text.encode("utf-8", "surrogatepass").split()
    return words, np.unique(np.fromiter((zlib.crc32(w) for w in set(words)), np.int64) & (WORDS - 1)).astype(np.int32)


class Machine:
    """Feature numbers: words, then the bins of each number, then the values of each text column."""

    def __init__(self, n_numbers: int, n_values: int, factors: int = FACTORS):
        self.n_numbers, self.n_values = n_numbers, n_values
        size = WORDS + n_numbers * BINS + n_values * VALUES
        self.bias, self.weight, self.vector = 0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
        self.edges = np.zeros((n_numbers, BINS - 1))

    def features(self, words: list[np.ndarray], numbers: np.ndarray, values: list[list[str | None]]):
        """(feature, value, where each row's begin) of a batch; a row's words have length 1 together."""
        index, value = [], []
        bins = [np.searchsorted(e, numbers[:, i], side="right") + WORDS + i * BINS for i, e in enumerate(self.edges)]
        bins = np.stack(bins, 1) if bins else np.empty((len(words), 0), np.int64)
        known = ~np.isnan(numbers)
        for i, own in enumerate(words):
            more = [WORDS + self.n_numbers * BINS + c * VALUES + zlib.crc32(v.encode("utf-8", "surrogatepass")) % VALUES for c, v in enumerate(values[i]) if v is not None]
            index += [own, bins[i][known[i]], np.array(more, np.int64)]
            value += [np.full(len(own), 1 / math.sqrt(max(1, len(own))), np.float32), np.ones(int(known[i].sum()) + len(more), np.float32)]
        sizes = np.array([sum(map(len, index[3 * i : 3 * i + 3])) for i in range(len(words))], np.int64)
        return np.concatenate([*index, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*value, np.empty(0, np.float32)]), np.r_[0, np.cumsum(sizes)]

    def _sums(self, index, value, at):
        """Each row's linear sum, sum of vectors and the vectors of its features."""
        v = self.vector[index] * value[:, None]
        return np.add.reduceat(self.weight[index] * value, at[:-1]), np.add.reduceat(v, at[:-1]), np.add.reduceat(v * v, at[:-1]).sum(1), v

    def raw(self, index, value, at) -> np.ndarray:
        """The machine's value for each row: half of (square of the sum - sum of squares) for the pairs."""
        out = np.full(len(at) - 1, self.bias)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            # Rows without features have none of the sums.
            linear, total, squares, _ = self._sums(index, value, np.r_[at[full], at[-1]])
            out[full] += linear + ((total * total).sum(1) - squares) / 2
        return out

    def score(self, index, value, at) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, at), -40, 40)))

    def fit(self, words, numbers: np.ndarray, values, labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
        """Learns bins and weights from the rows; their order matters, their number is bounded by the caller."""
        if not len(labels):
            return self
        with np.errstate(all="ignore"):
            self.edges = np.array([np.quantile(c[~np.isnan(c)], np.arange(1, BINS) / BINS) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in numbers.T]).reshape(self.n_numbers, BINS - 1)
        index, value, at = self.features(words, numbers, values)
        good = (labels.sum() + 0.5) / (len(labels) + 1)
        self.bias = math.log(good / (1 - good))
        if len(np.unique(labels)) < 2:
            return self
        random = np.random.default_rng(SEED)
        seen = np.unique(index)
        # Vectors of features that no labelled row has stay zero: they have no effect.
        self.vector[seen] = random.normal(0, 0.05, (len(seen), self.vector.shape[1]))
        past_w, past_v, past_b = np.full(len(self.weight), 1e-8, np.float32), np.full(self.vector.shape, 1e-8, np.float32), 1e-8
        for _ in range(epochs):
            order = random.permutation(len(labels))
            for first in range(0, len(order), BATCH):
                rows = order[first : first + BATCH]
                size = at[rows + 1] - at[rows]
                rows, size = rows[size > 0], size[size > 0]
                if not len(rows):
                    continue
                starts = np.r_[0, np.cumsum(size)]
                own = np.arange(starts[-1]) - np.repeat(starts[:-1] - at[rows], size)
                i, x = index[own], value[own]
                linear, total, squares, v = self._sums(i, x, starts)
                guess = 1 / (1 + np.exp(-np.clip(self.bias + linear + ((total * total).sum(1) - squares) / 2, -40, 40)))
                wrong = ((guess - labels[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(wrong, size) * x
                used, to = np.unique(i, return_inverse=True)
                w = np.bincount(to, each, len(used)) + DECAY * self.weight[used] / len(rows)
                pull = each[:, None] * (np.repeat(total, size, axis=0) - v)
                f = np.stack([np.bincount(to, c, len(used)) for c in pull.T], 1) + DECAY * self.vector[used] / len(rows)
                past_w[used] += w * w
                past_v[used] += f * f
                past_b += float(wrong.sum()) ** 2
                self.weight[used] -= (RATE * w / np.sqrt(past_w[used])).astype(np.float32)
                self.vector[used] -= (RATE / 2 * f / np.sqrt(past_v[used])).astype(np.float32)
                self.bias -= RATE * float(wrong.sum()) / math.sqrt(past_b)
        return self


def _columns(docs: DataFrame, metadata: tuple[str, ...]) -> tuple[list[str], list[str]]:
    numbers = [c for c in metadata if isinstance(docs.schema[c].dataType, T.NumericType)]
    return numbers, [c for c in metadata if c not in numbers]


def _features_of(batch, text: str, numbers: list[str], values: list[str]):
    texts = [t or "" for t in strings(batch, text)]
    split = [words_of(t) for t in texts]
    shape = [structure(t, w) for t, (w, _) in zip(texts, split, strict=True)]
    # Sizes in metadata are taken by their order of magnitude.
    more = [[math.nan if v is None else math.copysign(math.log2(1 + abs(float(v))), float(v)) for v in strings(batch, c)] for c in numbers]
    rows = np.array([[*s, *m] for s, m in zip(shape, zip(*more, strict=True) if more else [()] * len(texts), strict=True)], float).reshape(len(texts), -1)
    told = list(zip(*[strings(batch, c) for c in values], strict=True)) if values else [()] * len(texts)
    return [b for _, b in split], rows, [[None if v is None else str(v) for v in t] for t in told]


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), labelled_rows: int = LABELLED_ROWS, fit_features: int = FIT_FEATURES) -> Machine:
    """A machine learned from at most `labelled_rows` labels and `fit_features` features."""
    numbers, values = _columns(docs, metadata)
    known = labels.select(F.col(id).alias("__id"), F.col(label).cast("double").alias("__label")).where("__id IS NOT NULL AND __label IS NOT NULL")
    known = known.groupBy("__id").agg(F.min("__label").alias("__label")).withColumn("__draw", F.xxhash64("__id", F.lit(11)))
    known = known.orderBy("__draw", "__id").limit(labelled_rows)
    # A bounded set of labels, so of known size for a broadcast.
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), *numbers, *values).join(F.broadcast(known), "__id")

    def make():
        def compute(batch):
            words, numeric, told = _features_of(batch, "__text", numbers, values)
            return [[w.tobytes() for w in words], numeric.tolist(), told, [len(w) for w in words]]

        return compute

    added = [("__words", T.BinaryType()), ("__numbers", T.ArrayType(T.DoubleType())), ("__values", T.ArrayType(T.StringType())), ("__n", T.LongType())]
    sample = staged(map_arrow(rows, make, added, ["__draw", "__id", "__label"]), "labelled")
    order = ["__draw", "__id", "__words", "__numbers"]
    sizes = [r[0] for r in sample.select(*order, "__n").orderBy(*order).limit(labelled_rows).select("__n").collect()]
    fitting = int(np.searchsorted(np.cumsum(sizes), fit_features, side="right")) if sizes else 0
    taken = sample.orderBy(*order).limit(fitting).collect()
    machine = Machine(len(STATISTICS) + len(numbers), len(values))
    numeric = np.array([r["__numbers"] for r in taken], float).reshape(len(taken), machine.n_numbers)
    return machine.fit([np.frombuffer(r["__words"], np.int32) for r in taken], numeric, [r["__values"] for r in taken], np.array([r["__label"] > 0 for r in taken], float))


def score(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with score (0 to 1, higher: better) and predicted (1 from 0.5 on)."""
    numbers, values = _columns(docs, metadata)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = shared.value

        def compute(batch):
            scores = own.score(*own.features(*_features_of(batch, text, numbers, values)))
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

        return compute

    return map_arrow(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
