"""Language identification with blended-spectrum string kernels.

A text's features are the n-grams (n = 1 to 3) that occur in it at all; the kernel of two texts
is the number of n-grams they share over the geometric mean of their own. A bounded, balanced
sample of labelled texts is the training set, part of it the Nyström landmarks; kernel ridge
regression, one language against the rest, is solved in the landmarks' feature space. As the
kernel is linear in presence, landmarks and solution fold into one matrix from n-grams to
languages, and texts are scored by products of (sparse) presence matrices with it.

Symbols: every letter in lower case stands for itself, whatever its script; any other character
is a space.

Defined results: `und` with score 0 if the text is null or has no letter, or nothing was learned.
Labels that are null, or whose text has no letter, teach nothing; repeated rows teach once. Texts
are read whole; only training leaves aside texts longer than `MOST_CHARS`, of languages that have
shorter ones. Ties go to the language first in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import map_arrow, put_aside, restored, strings

#: Bounds of the training sample: rows for each language, characters of all of it (shared equally
#: by the languages) and of a text, languages (the most frequent ones). A language that has longer texts
#: only is learned from its shortest one, of up to `LONG_CHARS`.
ROWS_EACH, SAMPLE_CHARS, MOST_CHARS, LONG_CHARS, MOST_LANGUAGES = 300, 16_000_000, 20_000, 1_000_000, 5000
#: Bounds of the landmarks: texts (one a language at least) and characters (beyond those of that one).
LANDMARKS, LANDMARK_CHARS = 320, 1_000_000
RIDGE = 1e-2
UNKNOWN = "und"
SPACE, BITS = 32, 21


class _Letters:
    """For each code point whether it is a letter, found out when it is first met."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.known[points]
        new = points[out < 0]
        if len(new):
            self.known[new] = [chr(c).isalpha() for c in new.tolist()]
            out = self.known[points]
        return out > 0


_letters = _Letters()
_number = np.zeros(0x110000, np.int32)  # scratch: the number of a code point within a text


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text as 64-bit numbers in order; none if it has no letter.

    Code points are numbered within the text first, so that its n-grams are small numbers.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    own = np.unique(points)
    own = own[_letters(own)]
    if not len(own):
        return np.empty(0, np.int64)
    _number[own] = np.arange(1, len(own) + 1)
    one = _number[points]
    _number[own] = 0
    keep = np.ones(len(one), bool)
    keep[1:] = (one[1:] > 0) | (one[:-1] > 0)  # runs of spaces are one space
    one = np.concatenate([[0] if one[0] else [], one[keep], [0] if one[-1] else []]).astype(np.int64)
    b = len(own) + 1
    full = np.concatenate([[SPACE], own]).astype(np.int64)
    out = []
    code = one
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * b + one[n - 1 :]
        if b**n <= max(1 << 16, 4 * len(code)):
            seen = np.zeros(b**n, bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
        else:
            distinct = np.unique(code)
        wide = np.zeros(len(distinct), np.int64)
        for k in range(n - 1, -1, -1):
            wide = (wide << BITS) | full[distinct // b**k % b]
        out.append(wide)
    return np.concatenate(out)


class _Places:
    """Row of each n-gram in the weights, -1 for those that no landmark has."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab

    def __getitem__(self, codes):
        at = np.searchsorted(self.vocab, codes)
        at = np.minimum(at, len(self.vocab) - 1)
        return np.where(self.vocab[at] == codes, at, -1)


class Model:
    """`weights` has a row for each n-gram of the landmarks, a column for each language."""

    def __init__(self):
        self.languages: list[str] = []

    grams = staticmethod(grams)

    def fit(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        self.languages = sorted(set(languages))
        found = [grams(t) for t in texts]
        own = np.sqrt([float(len(g)) for g in found])
        chosen = self._landmarks(texts, languages, landmarks)
        vocab = np.unique(np.concatenate([found[i] for i in chosen]))
        self.place = _Places(vocab)
        # Landmarks that have an n-gram, one n-gram after the other.
        rows = np.concatenate([self.place[found[i]] for i in chosen])
        marks = np.repeat(np.arange(len(chosen)), [len(found[i]) for i in chosen])
        order = np.argsort(rows, kind="stable")
        marks, begin = marks[order], np.searchsorted(rows[order], np.arange(len(vocab) + 1))
        kernel = np.zeros((len(texts), len(chosen)))
        for i, g in enumerate(found):
            at = self.place[g]
            at = at[at >= 0]
            shared = np.concatenate([marks[begin[a] : begin[a + 1]] for a in at.tolist()]) if len(at) else at
            kernel[i] = np.bincount(shared, minlength=len(chosen)) / own[i] / own[chosen]
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-8 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        phi = kernel @ root
        target = np.array([[float(x == l) for l in self.languages] for x in languages])
        # Every language weighs the same, however many rows it has.
        weight = 1 / (target @ target.sum(axis=0))[:, None]
        solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(self.languages) / 100 * np.eye(phi.shape[1]), phi.T @ (weight * target))
        dual = (root @ solved / own[chosen][:, None]).astype(np.float32)
        self.weights = np.add.reduceat(dual[marks], begin[:-1], axis=0)
        return self

    @staticmethod
    def _landmarks(texts: list[str], languages: list[str], most: int) -> list[int]:
        """One text of each language, then more in turns, at even steps among a language's own, up to the
        bounds of texts and characters."""
        own: dict[str, list[int]] = {}
        for i, language in enumerate(languages):
            own.setdefault(language, []).append(i)
        each = max(1, most // max(1, len(own)))
        steps = []
        for _, rows in sorted(own.items()):
            first = rows[:: max(1, len(rows) // each)][:each]
            steps.append(first + sorted(set(rows) - set(first)))
        turns = [rows[n] for n in range(max(map(len, steps), default=0)) for rows in steps if n < len(rows)]
        chosen, chars = turns[: len(own)], sum(len(texts[i]) for i in turns[: len(own)])
        for i in turns[len(own) :]:
            if len(chosen) < most and chars + len(texts[i]) <= LANDMARK_CHARS:
                chosen.append(i)
                chars += len(texts[i])
        return sorted(chosen)

    BATCH = 128

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its presence vector times the weights, in blocks of texts."""
        return self._scores([grams(t) for t in texts])

    def _scores(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found), len(self.languages)), np.float32)
        for at in range(0, len(found), self.BATCH):
            part = found[at : at + self.BATCH]
            places = [p[p >= 0] for p in map(self.place.__getitem__, part)]
            full = [i for i, p in enumerate(places) if len(p)]
            if full:
                begin = np.cumsum([0] + [len(places[i]) for i in full[:-1]])
                sums = np.add.reduceat(self.weights[np.concatenate([places[i] for i in full])], begin, axis=0)
                out[[at + i for i in full]] = sums / np.sqrt([len(part[i]) for i in full])[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, marks = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, marks
        found = [grams(t) if t else _NONE for t in texts]
        known = [i for i, g in enumerate(found) if len(g)]
        if known:
            got = self._scores([found[i] for i in known])
            for i, k, s in zip(known, got.argmax(axis=1), got.max(axis=1), strict=True):
                names[i], marks[i] = self.languages[k], float(min(1.0, max(0.0, s)))
        return names, marks


_NONE = np.empty(0, np.int64)


def train(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows_each: int = ROWS_EACH, landmarks: int = LANDMARKS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from a sample of at most `rows_each` rows of each of the most frequent languages, and
    of about `sample_chars` characters in all (one row a language at least)."""
    rows = labelled.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") <= LONG_CHARS) & F.col("text").rlike(r"\p{L}"))
    short = F.length("text") <= MOST_CHARS
    # The share of each language that its quota asks for, and half as many again; then the quota, by hash.
    draw = F.xxhash64("id", "text", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1))
    counts = rows.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(short).alias("count"), F.min(F.when(short, draw)).alias("least"), F.min(F.struct(F.length("text"), draw.alias("draw")))["draw"].alias("shortest")).orderBy(F.desc("all"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Model()
    # One row a language, MOST_LANGUAGES at most.
    quotas = [(r.lang, max(int(min(1.0, (1.5 * rows_each + 20) / r["count"]) * (1 << 40)), r.least + 1) if r["count"] else 0, None if r["count"] else r.shortest) for r in counts]
    quota = labelled.sparkSession.createDataFrame(quotas, "lang string, quota long, only long")
    drawn = rows.withColumn("draw", draw).join(F.broadcast(quota), "lang").where((short & (F.col("draw") < F.col("quota"))) | (F.col("draw") == F.col("only"))).dropDuplicates(["lang", "draw", "text"])
    turn = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = drawn.withColumns({"nth": F.row_number().over(turn), "before": F.sum(F.length("text")).over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")})
    # Languages take turns, so that landmarks are balanced as well.
    sample = sorted((r.nth, r.lang, r.text) for r in drawn.where((F.col("nth") <= rows_each) & (F.col("before") < sample_chars // len(counts))).select("nth", "lang", "text").collect())
    return Model().fit([t for _, _, t in sample], [name for _, name, _ in sample], landmarks)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda batch: list(own.predict(strings(batch, text)))

    return map_arrow(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())])


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least_score: float = 0.3) -> DataFrame:
    """The filter: rows of unknown language, or of a score below `least_score`, go."""
    found = predict(put_aside(docs, text), model, text)
    return restored(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)), docs.columns, (text,))
