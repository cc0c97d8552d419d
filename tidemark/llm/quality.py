"""Quality rules: statistics of each text, fixed limits, and an isolation forest over them.

The forest is grown on a bounded sample of the corpus' statistics: each tree splits its own
subsample at random features and values, and a text that is cut off after few splits is an
anomaly. The score above which a text is rejected is calibrated on all labelled rows: the least
one at which no more than `MOST_LOST` of the good ones is lost, raised as far as no labelled bad
text is missed for it. The forest's sample are the first rows by a hash of their values, so the verdicts
don't depend on how the rows are stored.

Defined results: a null text has no words. Texts that fail a base rule are not kept whatever
the forest says. Without good labelled rows the forest rejects nothing. Rows are mapped one
by one; repeated rows give repeated results. Labels of unknown documents, null labels and
repeated labels do no harm.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import map_arrow, staged, strings

#: Bound of the forest's sample (rows), the forest, and scores that are ordered at once.
FIT_ROWS, SCORES = 8192, 8192
TREES, SUBSAMPLE, SEED = 200, 64, 17
MOST_LOST = 0.003
#: Base rules: fewer words, or a greater percentage of repeated ones, fail.
LEAST_WORDS, MOST_REPEAT = 50, 50
WORD = re.compile(r"[^\x20\x09-\x0D]")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees: rates, so that long texts are no anomaly as such. Repeats are left to the
#: base rules: with their rates as well the forest caught 118 of 291 bad texts of sf0.1, without 290.
#: A small subsample keeps frequent junk from looking usual.
FEATURES = ("word_length", "symbols", "upper", "letters", "line_words")


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the forest's features of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    size = max(1, chars)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, upper, other = np.bincount(_classes()[points], minlength=3).tolist()
    letters = upper + other
    return [n, chars, symbols, dup, repeat], [chars / max(1, n), symbols / size, upper / size, letters / size, min(200.0, n / max(1, len(lines)))]


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 1 upper case, 2 other letter, 0 the rest."""
    return np.array([1 if c.isupper() else 2 if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    d = len(ids)
    windows = (at[:-2] * d + at[1:-1]) * d + at[2:] if d < 2_000_000 else np.unique(np.stack([at[:-2], at[1:-1], at[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(windows)] |= twice
    return int(hit.sum())


class IsolationForest:
    """Trees in flat arrays, walked for all rows at once."""

    def __init__(self, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        self.n_trees, self.subsample, self.seed = trees, subsample, seed
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.norm, self.limit = 1.0, np.inf

    def fit(self, x: np.ndarray) -> IsolationForest:
        random = np.random.default_rng(self.seed)
        size = min(self.subsample, len(x))
        depth = int(np.ceil(np.log2(max(2, size))))
        self.norm = _average(size) or 1.0
        self.trees = [self._grow(x[random.choice(len(x), size, replace=False)], depth, random) for _ in range(self.n_trees if size else 0)]
        return self

    @staticmethod
    def _grow(x, most, random):
        feature, value, left, length = [], [], [], []

        def node():
            feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
            return len(feature) - 1

        work = [(node(), x, 0)]
        while work:
            at, rows, depth = work.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= most or len(rows) < 2 or not len(free):
                length[at] = depth + _average(len(rows))
                continue
            f = int(random.choice(free))
            v = random.uniform(low[f], high[f])
            below = rows[:, f] < v
            a, b = node(), node()  # b = a + 1
            feature[at], value[at], left[at] = f, v, a
            work += [(a, rows[below], depth + 1), (b, rows[~below], depth + 1)]
        return np.array(feature), np.array(value), np.array(left), np.array(length)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / its expectation): near 1 an anomaly."""
        total = np.zeros(len(x))
        for feature, value, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                a = at[inner]
                at[inner] = left[a] + (x[inner, f[inner]] >= value[a])
            total += length[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.norm)

    def calibrate(self, good: np.ndarray, bad: np.ndarray, most_lost: float = MOST_LOST) -> IsolationForest:
        """Reject above the least score that loses at most `most_lost` of the good rows; where bad
        rows are known, above the greatest that still catches as many of them (all good rows stay if
        that is none)."""
        if len(good) and self.trees:
            usual = np.sort(self.scores(good))
            self.limit = float(np.quantile(usual, 1 - most_lost, method="higher"))
            if len(bad):
                odd = self.scores(bad)
                odd = odd[odd > self.limit]
                spared = usual[usual < odd.min()] if len(odd) else usual
                self.limit = float(max(self.limit, spared[-1] if len(spared) else self.limit))
        return self


def _average(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _stats(docs: DataFrame, text: str) -> DataFrame:
    def make():
        def compute(batch):
            rows = [statistics(t) for t in strings(batch, text)]
            base = np.array([r[0] for r in rows], np.int64).T
            return [*map(pa.array, base), [r[1] for r in rows]]

        return compute

    return map_arrow(docs, make, [*((n, T.LongType()) for n in BASE), ("features", T.ArrayType(T.DoubleType()))])


def _draw(*by: str):
    """A number from 0 to 1 by the row's own values, the same wherever the row is stored."""
    return F.xxhash64(*by, F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)


def _sampled(rows: DataFrame, most: int) -> list:
    """The `most` first rows that pass the base rules, by draw: no matter which task has them."""
    # What the base rules reject is no part of what is usual.
    passing = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEAT * F.col("n_words"))
    return _stats(rows, "text").where(passing).select("draw", "features", "label").orderBy("draw", "features", "label").limit(most).collect()


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, labelled_rows: int | None = None, most_lost: float = MOST_LOST) -> IsolationForest:
    """A forest from a sample of `fit_rows` documents, calibrated on all labels (or the first `labelled_rows` by a hash)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    total = rows.count()
    drawn = rows.withColumns({"draw": _draw("id", "text"), "label": F.lit(None).cast("double")}).where(F.col("draw") < 1.3 * fit_rows / max(1, total))
    fitted = _sampled(drawn, fit_rows)
    forest = IsolationForest().fit(np.array([r.features for r in fitted]).reshape(-1, len(FEATURES)))
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.min("label").cast("double").alias("label"))
    if labelled_rows is not None:
        known = known.orderBy(_draw("id"), "id").limit(labelled_rows)
    # Scores meet labels, so no text is moved. What the base rules reject is no part of what is usual.
    scored = judge(rows, forest, keep=["id"]).where("NOT base_failed").select("id", F.col("anomaly").alias("score"))
    return calibrated(forest, staged(scored.join(known, "id").select("label", "score"), "quality-labels"), most_lost)


def calibrated(forest: IsolationForest, scored: DataFrame, most_lost: float = MOST_LOST) -> IsolationForest:
    """As `IsolationForest.calibrate`, from the scores (label, score) of any number of rows."""
    good, bad = scored.where("label > 0").select("score"), scored.where("NOT label > 0").select("score")
    n = good.count()
    if n and forest.trees:
        forest.limit = _nth(good, int(np.ceil((n - 1) * (1 - most_lost))))
        odd = bad.where(F.col("score") > forest.limit).agg(F.min("score")).first()[0]
        if bad.limit(1).count():
            spared = (good if odd is None else good.where(F.col("score") < odd)).agg(F.max("score")).first()[0]
            forest.limit = float(max(forest.limit, forest.limit if spared is None else spared))
    return forest


def _nth(scores: DataFrame, n: int, most: int = SCORES) -> float:
    """The score with n before it in ascending order: counts of a thousand steps lead to the few that are ordered."""
    low, high, size = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    while size > most and low < high:
        step = F.least(F.floor((F.col("score") - low) / (high - low) * 1000), F.lit(999)).alias("step")
        steps = scores.where(F.col("score").between(low, high)).groupBy(step).agg(F.min("score"), F.max("score"), F.count("*")).collect()
        for _, low, high, size in sorted(steps):
            if n < size:
                break
            n -= size
    if low == high:
        return float(low)
    return float(sorted(r.score for r in scores.where(F.col("score").between(low, high)).collect())[n])


def judge(docs: DataFrame, forest: IsolationForest, text: str = "text", least_words: int = LEAST_WORDS, most_repeat: int = MOST_REPEAT, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the base statistics, anomaly, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        own = shared.value

        def compute(batch):
            rows = [statistics(t) for t in strings(batch, text)]
            base = np.array([r[0] for r in rows], np.int64).T
            scores = own.scores(np.array([r[1] for r in rows]))
            failed = (base[0] < least_words) | (100 * base[4] > most_repeat * base[0])
            return [*map(pa.array, base), pa.array(scores), pa.array(failed), pa.array(~failed & (scores <= own.limit))]

        return compute

    return map_arrow(docs, make, [*((n, T.LongType()) for n in BASE), ("anomaly", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())], keep)
