"""A Merkle manifest of a dataset: one digest a row, a tree for each group of rows, a tree over the groups.

Rows of a group in order of their key are its leaves. Nodes of a level are taken in runs of
`arity`; the last run may be shorter. How many children a parent has follows from the number of
nodes of its level, so a parent knows by itself when it is whole.

The tree grows by events: a task keeps partial parents by key, each with the digests of the
children that have come, by index. The child that makes a parent whole turns it into a node of
the next level at once, which is an event for its own parent. What is still partial when the
rows of a task end is the unresolved frontier, a few nodes a level: it is shuffled by the block
of `arity ** height` leaves that it belongs to and combined there. The tops of the blocks are the
leaves of the next round, so a round makes 4,096 nodes into one.

Proofs follow the links back, from the root down: the path above a block's top goes with the
block's nodes into one task, which holds one block at a time, and gives each its own path.

How it scales: texts are read once, where they lie; digests alone are shuffled (once by key, once
by block). Groups of any size are ranges over many tasks, a row's number being its place in its
task's stretch and the rows of the stretches before. Nothing is collected but the root.

Defined results: null values are marked as such. Rows without key come first, rows of equal keys
in order of their digests; repeated rows are leaves of their own. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import bound_batches, map_arrow, staged, strings

ARITY, HEIGHT = 2, 12


def leaf(*columns: str | Column) -> Column:
    """The digest of a row: sha256 over its values, each with its length in bytes, `-` for null."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined_digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for step in path.split("/")[:-1]:
        left, right = step.split("|")
        digest = joined_digest([left, digest, right])
    return digest


def siblings_digest(path: str) -> str:
    """sha256 of all siblings on a path, in order."""
    return sha256(path.replace("|", "").replace("/", "").encode()).hexdigest()


def group_text(group: str) -> Column:
    """The group as a text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with their number `at` in their group `grp` and the group's `size`, in `order`."""
    bound_batches(rows.sparkSession)
    by = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order], F.col("__n")]
    # Rows that are equal in all else differ by number, so any stretch of them can be divided.
    dealt = rows.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__n")

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = np.array(batch.column(batch.schema.get_field_index("grp")).to_pylist(), object)
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            slot = np.arange(len(names)) - np.repeat(starts, np.diff(np.r_[starts, len(names)]))
            if names[0] == last:
                slot[: starts[1] if len(starts) > 1 else None] += n
            last, n = names[-1], int(slot[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(slot)], names=[*batch.schema.names, "part", "slot"])

    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("slot", T.LongType())])
    placed = staged(dealt.mapInArrow(lambda batches: run(b for b in batches if b.num_rows), schema), "leaves")
    # One row for each stretch of a group: as many as tasks and groups.
    stretches = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    own = Window.partitionBy("grp")
    stretches = stretches.select("grp", "part", (F.sum("rows").over(own.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(own).alias("size"))
    return placed.join(stretches, ["grp", "part"]).withColumn("at", F.col("before") + F.col("slot")).drop("part", "slot", "before")


_NODE = T.StructType([T.StructField("grp", T.StringType()), T.StructField("size", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("whole", T.BooleanType())])


class Combiner:
    """Partial parents by (group, level, index), with the digests of the children seen so far."""

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.partial: dict[tuple, dict[int, str]] = {}
        self.sizes: dict[str, int] = {}

    def add(self, grp: str, size: int, level: int, at: int, digest: str):
        """Takes a node; gives a row where it, or an ancestor that it completes, ends the block."""
        here = -(-size // self.arity**level)
        while here > 1 and level < self.height:
            parent = at // self.arity
            key = (grp, level, parent)
            children = self.partial.setdefault(key, {})
            children[at] = digest
            if len(children) < min(self.arity, here - parent * self.arity):
                self.sizes[grp] = size
                return None
            del self.partial[key]
            digest = joined_digest([children[i] for i in sorted(children)])
            at, level, here = parent, level + 1, -(-here // self.arity)
        return grp, size, level, at, digest, True

    def frontier(self):
        """The nodes whose parents have stayed partial."""
        for (grp, level, _), children in self.partial.items():
            for at, digest in children.items():
                yield grp, self.sizes[grp], level, at, digest, False


def _combined(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    bound_batches(nodes.sparkSession)
    names = _NODE.fieldNames()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=names)

    def run(batches):
        combiner, out = Combiner(arity, height), []
        for batch in batches:
            for node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = combiner.add(*node)
                if row:
                    out.append(row)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        out += combiner.frontier()
        if out:
            yield batch_of(out)

    return nodes.select("grp", "size", "level", "at", "digest").mapInArrow(run, _NODE)


class Tree(NamedTuple):
    """`rounds`: the nodes that each round began with (grp, size, at, digest); `tops`: the groups'
    roots that it reached (grp, digest)."""

    rounds: list[DataFrame]
    tops: list[DataFrame]
    arity: int
    height: int

    def roots(self) -> DataFrame:
        out = self.tops[0]
        for more in self.tops[1:]:
            out = out.union(more)
        return out


def grow(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> Tree:
    """The trees over numbered leaves (grp, size, at, digest)."""
    tree = Tree([], [], arity, height)
    nodes = leaves.select("grp", "size", "at", "digest")
    while True:
        tree.rounds.append(nodes)
        met = staged(_combined(nodes.withColumn("level", F.lit(0)), arity, height), "nodes")
        block = F.floor(F.col("at") / F.pow(F.lit(float(arity)), F.lit(height) - F.col("level"))).cast("long")
        late = _combined(met.where("NOT whole").repartition("grp", block), arity, height)
        whole = staged(met.where("whole").union(late), "tops")
        size = F.ceil(F.col("size") / F.pow(F.lit(float(arity)), F.col("level"))).cast("long")
        whole = whole.select("grp", size.alias("size"), "at", "digest")
        tree.tops.append(whole.where("size = 1").select("grp", "digest"))
        nodes = whole.where("size > 1")
        if nodes.isEmpty():
            return tree


def _block_paths(size: int, digests: list[str], above: str, arity: int, height: int) -> list[str]:
    """The path of each node of a block, whose nodes are all there, given the path above its top."""
    levels, here = [digests], size
    while here > 1 and len(levels) <= height:
        last = levels[-1]
        levels.append([joined_digest(last[i : i + arity]) for i in range(0, len(last), arity)])
        here = -(-here // arity)
    paths = [above]
    for level in levels[-2::-1]:
        paths = ["".join(level[i - i % arity : i]) + "|" + "".join(level[i + 1 : i - i % arity + arity]) + "/" + paths[i // arity] for i in range(len(level))]
    return paths


def _paths(nodes: DataFrame, above: DataFrame, arity: int, height: int) -> DataFrame:
    """(grp, at, digest, row, subroot, path) of nodes (grp, size, at, digest, row), from the paths (grp, at,
    subroot, path) of the tops of their blocks."""
    bound_batches(nodes.sparkSession)
    wide = arity**height
    own = nodes.select("grp", F.expr(f"at div {wide}").alias("block"), "at", "size", "digest", "row", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("path"))
    tops = above.select("grp", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"), "subroot", "path")
    # The path of a block's top comes first, then its nodes in order.
    dealt = own.union(tops).repartition("grp", "block").sortWithinPartitions("grp", "block", "at")

    def give(rows: pa.Table):
        at, size, digest, subroot, path = (rows.column(c).to_pylist() for c in ("at", "size", "digest", "subroot", "path"))
        starts = [*[i for i, n in enumerate(at) if n == -1], len(at)]
        roots, out = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            out += _block_paths(size[a + 1], digest[a + 1 : b], path[a], arity, height)
            roots += [subroot[a]] * (b - a - 1)
        kept = rows.filter(pa.array([n != -1 for n in at]))
        return pa.table([*(kept.column(c) for c in ("grp", "at", "digest", "row")), pa.array(roots, pa.string()), pa.array(out, pa.string())], names=["grp", "at", "digest", "row", "subroot", "path"]).to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            rest = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)])
            # All but the last block is there in full.
            tops_at = np.flatnonzero(rest.column("at").to_numpy() == -1)
            if len(tops_at) > 1:
                yield from give(rest.slice(0, tops_at[-1]).combine_chunks())
                rest = rest.slice(tops_at[-1])
        if rest is not None and rest.num_rows:
            yield from give(rest.combine_chunks())

    schema = T.StructType([nodes.schema["grp"], T.StructField("at", T.LongType()), nodes.schema["digest"], nodes.schema["row"], T.StructField("subroot", T.StringType()), T.StructField("path", T.StringType())])
    return dealt.mapInArrow(run, schema)


def _descend(tree: Tree, leaves: DataFrame, over: DataFrame) -> DataFrame:
    """`_paths` of the leaves, given (grp, path) over the roots of the groups."""
    rounds = [r.withColumn("row", F.lit(None).cast("string")) for r in tree.rounds[1:]]
    found = None
    for nodes, tops in zip([leaves, *rounds][::-1], tree.tops[::-1], strict=True):
        # Groups that end in this round have one block, whose top is their root.
        above = tops.join(over, "grp").select("grp", F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "path")
        if found is not None:
            above = above.unionByName(staged(found.select("grp", "at", "subroot", "path"), "paths"))
        found = _paths(nodes, above, tree.arity, tree.height)
    return found


def manifest(df: DataFrame, columns: list[str], group: str, key: str, carried: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, path, and the `carried` expressions over df's columns) of every row.

    `path` holds the siblings from leaf to root, a step a level: those to the left, `|`, those to
    the right, `/`.
    """
    carried = carried or {}
    facts = F.struct(F.col(key).alias("key"), *[e.alias(n) for n, e in carried.items()])
    # Read and hashed once; from here on digests stand for the rows.
    hashed = staged(df.select(group_text(group).alias("grp"), leaf(*columns).alias("digest"), facts.alias("row")), "digests")
    leaves = numbered(hashed.withColumn("key", F.col("row.key")), "key", "digest").drop("key")
    tree = grow(leaves, arity, height)
    groups = numbered(tree.roots().select(F.lit("").alias("grp"), "digest", F.col("grp").alias("row")), "row")
    top = grow(groups, arity, height)
    over = _descend(top, groups, top.roots().select("grp", F.lit("").alias("path")))
    over = staged(over.select(F.col("row").alias("grp"), "path"), "over")
    root = top.roots().first()
    found = _descend(tree, leaves, over)
    return found.select(F.col("row.key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(root and root.digest).cast("string").alias("root"), "path", *[F.col(f"row.{n}").alias(n) for n in carried])


def proven(found: DataFrame, leaf: str = "leaf") -> DataFrame:
    """`manifest`'s rows with proof_sha256, folded_root (of column `leaf` and the path) and verified."""

    def make():
        def compute(batch):
            paths, folded = strings(batch, "path"), [fold(d, p) for d, p in zip(strings(batch, leaf), strings(batch, "path"), strict=True)]
            return [[siblings_digest(p) for p in paths], folded, [f == r for f, r in zip(folded, strings(batch, "root"), strict=True)]]

        return compute

    return map_arrow(found, make, [("proof_sha256", T.StringType()), ("folded_root", T.StringType()), ("verified", T.BooleanType())])
