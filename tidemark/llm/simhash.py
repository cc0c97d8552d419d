"""SimHash near-duplicate groups, found with vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. All pairs within `radius` differing bits
are linked and every document gets the smallest id of its connected component.

How it scales: equal fingerprints collapse first, so copies cost nothing more. Over the whole
64 bits the distances of unrelated texts crowd around 32, and a tree split at any radius would
send most fingerprints to both sides. Distances under a mask of 16 bits are a metric as well,
and two fingerprints within 3 bits agree on at least one of four such masks; so the shards are
the radius-0 balls of the four masked metrics and a fingerprint is asked in each of the four
balls that it lies in. Balls of more than `most_in_ball` fingerprints are divided again by masks
of their remaining bits, again and again until none is left: the bits run out before that, so no
task ever holds more. In every ball a vantage-point tree over whole fingerprints finds the
exact neighbours, pruned by the triangle inequality, and a fingerprint that has joined a
component leaves the tree, so a ball of near copies takes about as many distances as members
and yields a spanning forest, never its pairs. Links and components stay distributed:
components come from rounds of neighbour minimum and pointer jumping over staged tables.

`one_of_similar`, the filter of corpora, has a wider rule: texts whose sets of five-word shingles
have a Jaccard similarity of about 0.8 or more. Their fingerprints differ in up to 16 bits, for which
no few masks are exact; so every text has a fingerprint of 1,024 bits as well. Texts meet in the
balls of 48 of its stretches of 16 bits, where trees find those whose 64 bits are near enough, and
the 1,024 bits decide. What is found leaves the ball's tree, so a ball has fewer links than members; a
text that another one takes out of a ball meets the rest in other balls. Groups of near copies shrink
first, by the links within 3 bits: of those only texts that are linked to no smaller one go on.

Defined results: a null text has no words, as an empty one; texts without words have
fingerprint zero, linked like any other. Repeated rows and equal texts share a fingerprint.
A null id never becomes a component's id unless all of its ids are null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import PLACE, map_arrow, placed, staged, strings, without

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of a ball from which it is divided again; balls that agree in all bits but these aren't.
MOST_IN_BALL, FREE_BITS = 4096, 11
#: The rule of `one_of_similar`: words of a shingle, similarity; words of 64 bits of a wide fingerprint,
#: its stretches of 16 bits that make balls, and the radius in a ball.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
WIDE_WORDS, STRETCHES, WIDE_RADIUS = 16, 48, 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed long."""

    def make():
        def compute(batch):
            out = np.array([fingerprint(shingle_hashes(t, shingle)) for t in strings(batch, text)], np.uint64)
            return [pa.array(out.view(np.int64))]

        return compute

    return map_arrow(docs, make, [("fp", T.LongType())])


def distances(one: np.uint64, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one)


class VantageTree:
    """Over distinct fingerprints; `take` returns and removes those within a radius."""

    LEAF = 64

    def __init__(self, points: np.ndarray):
        self.points, self.alive = points, np.ones(len(points), bool)
        self.nodes: list[list] = []  # [vantage, radius, inner, outer] or [members]
        self.left: list[int] = []  # members alive below each node
        self.up: list[int] = []
        self.leaf_of = np.zeros(len(points), np.int64)
        self._build()

    def _build(self) -> None:
        work = [(np.arange(len(self.points)), -1, 0)]
        while work:
            ids, parent, side = work.pop()
            me = len(self.nodes)
            self.up.append(parent)
            self.left.append(len(ids))
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if len(ids) > self.LEAF:
                vantage = self.points[ids[0]]
                far = distances(vantage, self.points[ids])
                cut = int(np.median(far))
                inner = far <= cut
                if not inner.all():
                    self.nodes.append([vantage, cut, -1, -1])
                    work += [(ids[inner], me, 0), (ids[~inner], me, 1)]
                    continue
            self.nodes.append([ids])
            self.leaf_of[ids] = me

    def remove(self, ids) -> None:
        for i in ids:
            if self.alive[i]:
                self.alive[i] = False
                node = self.leaf_of[i]
                while node >= 0:
                    self.left[node] -= 1
                    node = self.up[node]

    def take(self, point: np.uint64, radius: int) -> np.ndarray:
        got = self.near(point, radius)
        self.remove(got)
        return got

    def near(self, point: np.uint64, radius: int) -> np.ndarray:
        found, work = [], [0]
        while work:
            at = work.pop()
            if not self.left[at]:
                continue
            node = self.nodes[at]
            if len(node) == 1:
                ids = node[0]
                if self.left[at] < len(ids):
                    ids = node[0] = ids[self.alive[ids]]
                near = ids[distances(point, self.points[ids]) <= radius]
                if len(near):
                    found.append(near)
                continue
            vantage, cut, inner, outer = node
            far = int(point ^ vantage).bit_count()
            if far - radius <= cut:
                work.append(inner)
            if far + radius > cut:
                work.append(outer)
        return np.concatenate(found) if found else _NONE


_NONE = np.empty(0, np.int64)


def forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points the smallest position in its component."""
    root = np.arange(len(points))
    tree = VantageTree(points)
    for i in range(len(points)):
        if tree.alive[i]:
            tree.remove([i])
            front = [i]
            while front:
                got = tree.take(points[front.pop()], radius)
                root[got] = i
                front += got.tolist()
    return root


def ball_links(keys: list[np.ndarray], fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components in each ball, a run of equal keys (rows sorted by keys)."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, n))
    left, right = [], []
    for a, size in zip(start[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = fps[a : a + size]
        root = forest(own, radius)
        linked = np.flatnonzero(root != np.arange(size))
        if len(linked):
            left.append(own[root[linked]])
            right.append(own[linked])
    return np.concatenate(left or [np.empty(0, np.uint64)]), np.concatenate(right or [np.empty(0, np.uint64)])


class Masks:
    """The masks that divide fingerprints into balls, as a tree: each node's mask holds its parent's
    bits and one of `radius` + 1 parts of the others, so two fingerprints within the radius that
    agree under a mask agree under one of its children's as well."""

    def __init__(self, radius: int):
        self.parts = radius + 1
        self.free = [list(range(64))]  # by number: bits that a mask leaves free
        self.mask = [0]

    def children(self, level: list[int]) -> list[tuple[int, int, int]]:
        """(parent, child, the child's mask as a signed long) for each of the nodes in `level`."""
        out = []
        for parent in level:
            bits = self.free[parent]
            for i in range(self.parts):
                own = bits[len(bits) * i // self.parts : len(bits) * (i + 1) // self.parts]
                self.free.append([b for b in bits if b not in own])
                self.mask.append(self.mask[parent] | sum(1 << b for b in own))
                out.append((parent, len(self.free) - 1, int(np.uint64(self.mask[-1]).astype(np.int64))))
        return out

    def divisible(self, node: int) -> bool:
        return len(self.free[node]) > FREE_BITS


def balls(unique: DataFrame, radius: int = RADIUS, most_in_ball: int = MOST_IN_BALL) -> DataFrame:
    """(fp, mask, value): the balls that each distinct fingerprint lies in."""
    spark, masks = unique.sparkSession, Masks(radius)

    def value(bits):
        return F.col("fp").bitwiseAND(bits).alias("value")

    def divided(rows: DataFrame, level: list[int]) -> DataFrame:
        # One row a mask of the level: 16, 64, 256, ... of them.
        table = spark.createDataFrame(masks.children(level), "mask int, child int, bits long")
        return rows.join(F.broadcast(table), "mask").select("fp", F.col("child").alias("mask"), value(F.col("bits")))

    first = F.array(*[F.struct(F.lit(child).alias("mask"), F.lit(bits).alias("bits")) for _, child, bits in masks.children([0])])
    asked = unique.select("fp", F.explode(first).alias("k")).select("fp", F.col("k.mask").alias("mask"), value(F.col("k.bits")))
    done = []
    while True:
        # A ball's number of members is known before anyone gathers it; overfull ones go to finer balls.
        full = staged(asked.groupBy("mask", "value").count().where(F.col("count") > most_in_ball).select("mask", "value"), "balls")
        level = sorted(m for m in (r.mask for r in full.select("mask").distinct().collect()) if masks.divisible(m))
        if not level:
            break
        full = full.where(F.col("mask").isin(level))
        done.append(asked.join(full, ["mask", "value"], "left_anti"))
        asked = staged(divided(asked.join(full, ["mask", "value"], "left_semi"), level), "divided")
    for part in done:
        asked = asked.unionByName(part)
    return asked


def near_links(unique: DataFrame, radius: int = RADIUS, most_in_ball: int = MOST_IN_BALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints that keep the components of `radius`."""
    names = ["mask", "value"]
    # In order within a ball too, so that a task that runs again makes the same links.
    dealt = balls(unique, radius, most_in_ball).repartition(*names).sortWithinPartitions(*names, "fp")
    return dealt.mapInArrow(lambda batches: _in_balls(batches, names, lambda keys, fps: ball_links(keys, fps, radius)), "a long, b long")


def _in_balls(batches, names: list[str], links):
    """`links` of whole balls, as runs of equal `names` end; only one ball is held at a time."""
    held: list[pa.RecordBatch] = []  # rows of the ball that is still open, and of the last batch

    def linked(rows):
        rows = pa.Table.from_batches(rows)
        a, b = links([rows[n].to_numpy() for n in names], rows["fp"].to_numpy().view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [np.flatnonzero(c[1:] != c[:-1]) for c in (batch[n].to_numpy() for n in names)]
        done = max(int(e[-1]) + 1 if len(e) else 0 for e in ends)
        if not done and held and any(batch[n][0] != held[-1][n][0] for n in names):
            yield from linked(held)
            held = []
        if done:
            yield from linked([*held, batch.slice(0, done)])
            held = []
        held.append(batch.slice(done))
    if held:
        yield from linked(held)


def components(links: DataFrame, label: DataFrame) -> DataFrame:
    """Smallest label reachable from each node. links: (a, b); label: (fp, low) of all nodes.

    Returns (fp, low, root) of the nodes in links; root, a fingerprint, is each component's own,
    also where two bear the same label. Each round every node takes the least label of its
    neighbours, then that of the node which bears its label: components of any shape shrink by
    a factor in each round. Nothing but one count a round comes to the driver.
    """
    # Staged before it is turned round: links made twice may be other links that span the same components.
    once = staged(links.where("a != b").distinct(), "links")
    both = once.union(once.select("b", "a"))
    if once.isEmpty():
        return label.withColumn("root", F.col("fp")).limit(0)
    # Labels are fingerprints while rounds run, ordered by (least id, fingerprint).
    node = both.select(F.col("a").alias("fp")).distinct().join(label, "fp").select("fp", F.struct(F.col("low").isNull().alias("none"), "low", "fp").alias("best"))
    node = staged(node, "nodes")
    while True:
        near = both.join(node.withColumnRenamed("fp", "b").withColumnRenamed("best", "theirs"), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        # Read twice below; Spark runs its exchanges once.
        step = node.join(near, node.fp == near.a, "left").select("fp", F.least("best", F.coalesce("theirs", "best")).alias("new"), F.col("best").alias("old"))
        jump = step.select(F.col("fp").alias("root"), F.col("new").alias("further"))
        after = step.join(jump, F.col("new.fp") == F.col("root"), "left").select("fp", F.least("new", F.coalesce("further", "new")).alias("best"), "old")
        after = staged(after, "nodes")
        changed = not after.where(F.col("best") != F.col("old")).isEmpty()
        node = after.select("fp", "best")
        if not changed:
            return node.select("fp", F.col("best.low").alias("low"), F.col("best.fp").alias("root"))


def wide_fingerprint(hashes: np.ndarray, words: int = 16) -> bytes:
    """A fingerprint of 64 * words bits: that of the hashes, and of what mixing makes of them."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(words):
            x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(fingerprint(x ^ (x >> np.uint64(31))))
    return np.array(out, np.uint64).tobytes()


def most_bits(similarity: float, bits: int) -> int:
    """How many of `bits` may differ: the mean at that Jaccard similarity, and one and a half standard deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + 1.5 * np.sqrt(bits * share * (1 - share)))


def candidate_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a ball from the first of its fingerprints to those within the radius, which leave, and so on."""
    left, right = [], []
    tree = VantageTree(fps)
    for i in range(len(fps)):
        if tree.alive[i]:
            tree.remove([i])
            near = tree.take(fps[i], radius)
            left.append(np.repeat(fps[i], len(near)))
            right.append(fps[near])
    return np.concatenate(left or [np.empty(0, np.uint64)]), np.concatenate(right or [np.empty(0, np.uint64)])


def _candidates(keys: list[np.ndarray], fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    start = np.flatnonzero(new)
    sizes = np.diff(np.r_[start, len(fps)])
    found = [candidate_links(fps[a : a + n], radius) for a, n in zip(start[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True)]
    return np.concatenate([np.empty(0, np.uint64), *(a for a, _ in found)]), np.concatenate([np.empty(0, np.uint64), *(b for _, b in found)])


def _alike(links: DataFrame, unique: DataFrame, most: int, words: int) -> DataFrame:
    """The links whose wide fingerprints differ in `most` bits at most."""
    pairs = links.join(unique.select(F.col("fp").alias("a"), F.col("wide").alias("wa")), "a").join(unique.select(F.col("fp").alias("b"), F.col("wide").alias("wb")), "b")

    def near(batches):
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(-1, words) for c in ("wa", "wb"))
            yield batch.filter(pa.array(np.bitwise_count(one ^ other).sum(axis=1) <= most)).select(["a", "b"])

    return pairs.mapInArrow(near, "a long, b long")


def similar_links(unique: DataFrame, similarity: float = SIMILARITY, stretches: int = STRETCHES, radius: int = WIDE_RADIUS, words: int = WIDE_WORDS) -> DataFrame:
    """Links (a, b) between fingerprints (fp, wide) whose wide ones differ in `most_bits` at most."""
    most = most_bits(similarity, 64 * words)
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    close = staged(_alike(staged(near_links(unique.select("fp")).select(*ends).distinct(), "close"), unique, most, words), "close")
    # What is linked to a smaller one is in that one's group already.
    firsts = unique.join(close.select(F.col("b").alias("fp")).distinct(), "fp", "left_anti")
    each = F.array(*[F.xxhash64(F.lit(i), F.substring("wide", 2 * i + 1, 2)) for i in range(stretches)])
    asked = firsts.select("fp", F.explode(each).alias("ball"))
    dealt = asked.repartition("ball").sortWithinPartitions("ball", F.xxhash64("fp"), "fp")
    met = dealt.mapInArrow(lambda batches: _in_balls(batches, ["ball"], lambda keys, fps: _candidates(keys, fps, radius)), "a long, b long")
    met = staged(met.select(*ends).distinct(), "met")
    return close.union(_alike(met, unique, most, words))


def _similar_groups(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of `docs` (doc_id, text, others) without texts, with fp and root, a group's own fingerprint."""

    def make():
        def compute(batch):
            hashes = [shingle_hashes(t, shingle) for t in strings(batch, "text")]
            return [pa.array(np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)), [wide_fingerprint(h, WIDE_WORDS) for h in hashes]]

        return compute

    fps = staged(map_arrow(docs, make, [("fp", T.LongType()), ("wide", T.BinaryType())]).drop("text"), "fingerprints")
    unique = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("wide").alias("wide")), "unique")
    low = components(similar_links(unique, similarity), unique.select("fp", "low"))
    roots = low.select("fp", "root")
    return fps.drop("wide").join(staged(roots, "components"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _grouped(docs: DataFrame, shingle: int, radius: int, most_in_ball: int = MOST_IN_BALL) -> DataFrame:
    """The rows of `docs` (doc_id, text, others) without texts, with fp, component_id and root."""
    fps = staged(fingerprints(docs, "text", shingle).drop("text"), "fingerprints")
    label = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "unique")
    low = components(near_links(label.select("fp"), radius, most_in_ball), label)
    lowest = label.join(low.withColumnRenamed("low", "lower"), "fp", "left").select("fp", F.coalesce("lower", "low").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return fps.join(staged(lowest, "components"), "fp", "left")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, most_in_ball: int = MOST_IN_BALL) -> DataFrame:
    """(id, fingerprint, component_id) of every row of `docs`."""
    found = _grouped(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), shingle, radius, most_in_ball)
    return found.select(F.col("doc_id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The filter by the rule of `near_duplicates`: of each component only one row stays, one of its smallest id.

    Rows are told apart by their places, so rows that share an id, or have none, and belong to
    different components all stay. Of several rows of the smallest id that with the least hash
    of its text stays. Texts don't move: the places of the rows that go meet them where they are read.
    """
    return _first_of_groups(docs, id, text, lambda rows: _grouped(rows, shingle, radius))


def one_of_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The filter by similarity: as `one_of_each`, of groups that links of `similarity` or more make."""
    return _first_of_groups(docs, id, text, lambda rows: _similar_groups(rows, shingle, similarity))


def _first_of_groups(docs: DataFrame, id: str, text: str, grouped) -> DataFrame:
    columns = docs.columns
    keyed = placed(docs)
    found = grouped(keyed.select(*PLACE, F.col(id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy")))
    found = staged(found.select(*PLACE, "doc_id", "copy", "root"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", *PLACE)
    least = found.groupBy("root").agg(F.min(order).alias("m"), F.count("*").alias("n")).where("n > 1").select("root", *[F.col("m")[c].alias(f"m{c}") for c in PLACE])
    same = reduce(Column.__and__, [F.col(c) == F.col(f"m{c}") for c in PLACE])
    return without(keyed, found.join(staged(least, "least"), "root").where(~same), columns)
