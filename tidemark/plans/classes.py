"""Pairs of rows by the classes they fall in: rows that are alike in all that a rule looks at.

What a rule says of two rows holds for all rows of their classes, so it is worked out once for each
pair of classes. Only then are pairs of rows made, each of them once, so nothing is grouped or moved
for each pair: members travel in blocks, and two blocks that meet give their pairs where they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, about, and of a piece of one: what two pieces give is held at once, no more.
BLOCK, PIECE = 1024, 32


def tasks(df: DataFrame) -> int:
    """Partitions of a step whose rows are few and whose work is large, which Spark would put together by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def expanded(related: DataFrame, members: DataFrame, id: str, block: int = BLOCK, tell: tuple[str, ...] = ()) -> DataFrame:
    """(p1 < p2, further columns of `related`) for related (c1, c2, ...) and members (class, `id`): all pairs of
    different members of related classes. A pair of classes, of one with itself too, comes once and in one order.

    `tell` names more columns of `members`, which come along as those of p1 and p2 with 1 and 2 after their names
    (it costs more, as do all columns of pairs).
    """
    keep = [c for c in related.columns if c not in ("c1", "c2")]
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = members.join(sizes, "class").select("class", F.pmod(F.xxhash64(id), F.col("parts")).cast("int").alias("part"), F.struct(F.col(id).alias("id"), *tell).alias("m") if tell else F.col(id).alias("m"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("ms"), F.lit(PIECE)), lambda i: F.slice("ms", i, F.lit(PIECE)))
    blocks = own.groupBy("class", "part").agg(F.collect_list("m").alias("ms")).select("class", "part", pieces.alias("ms"))
    part = lambda c, p: sizes.select(F.col("class").alias(c), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(p))
    meet = related.join(part("c1", "i1"), "c1").join(part("c2", "i2"), "c2").where("c1 != c2 OR i1 <= i2")
    meet = meet.join(blocks.select(F.col("class").alias("c1"), F.col("part").alias("i1"), F.col("ms").alias("ms1")), ["c1", "i1"])
    meet = meet.join(blocks.select(F.col("class").alias("c2"), F.col("part").alias("i2"), F.col("ms").alias("ms2")), ["c2", "i2"])
    same = (F.col("c1") == F.col("c2")) & (F.col("i1") == F.col("i2"))
    # A block that meets itself travels once.
    meet = meet.select(*keep, same.alias("same"), "ms1", F.when(~same, F.col("ms2")).alias("ms2")).repartition(tasks(related))
    met = meet.select(*keep, "same", F.coalesce("ms2", "ms1").alias("ms2"), F.explode("ms1").alias("s1")).select(*keep, "same", "s1", F.explode("ms2").alias("s2"))
    # Of the same number, so it moves nothing: it parts the steps, else all pairs of two blocks would be made before the first is taken.
    met = met.coalesce(tasks(related))
    each = met.select(*keep, "same", "s2", F.explode("s1").alias("m1")).select(*keep, "same", "m1", F.explode("s2").alias("m2"))
    a, b = (F.col("m1.id"), F.col("m2.id")) if tell else (F.col("m1"), F.col("m2"))
    each = each.where((a < b) | (~F.col("same") & (a != b)))
    first, other = F.when(a < b, F.col("m1")).otherwise(F.col("m2")), F.when(a < b, F.col("m2")).otherwise(F.col("m1"))
    if not tell:
        return each.select(first.alias("p1"), other.alias("p2"), *keep)
    return each.select(first["id"].alias("p1"), other["id"].alias("p2"), *[x[c].alias(f"{c}{n}") for c in tell for n, x in ((1, first), (2, other))], *keep)


def crossed(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """left (class, ...) with right (class, ...) of the same class, all with all, without `class`.

    Both travel in blocks and give their pairs where they meet, so what is moved grows with the rows of both.
    """

    def blocks(df, name):
        own = [c for c in df.columns if c != "class"]
        sizes = df.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        rows = df.join(sizes, "class").select("class", F.pmod(F.xxhash64(*own), F.col("parts")).alias("part"), F.struct(*own).alias("m"))
        return rows.groupBy("class", "part").agg(F.collect_list("m").alias(name)).drop("part")

    met = blocks(left, "ls").join(blocks(right, "rs"), "class").select("ls", "rs").repartition(tasks(left))
    each = met.select("rs", F.explode("ls").alias("l")).select("l", F.explode("rs").alias("r"))
    return each.select("l.*", "r.*")
