"""Running totals and predecessors within keys that may hold any number of rows.

A window over a key puts all of the key's rows into one task. Where a key holds more than `MOST`
rows, the rows are dealt out by range over (key, order) instead, so that a key lies in stretches,
one a task; windows go over a stretch, and what the stretches before leave to it (a sum, the last
k values) comes from a table with one row for each stretch of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.components import written

#: Rows of one key that a task may order.
MOST = 1_000_000
_PART, _AT = "__part", "__at"


class Scan:
    """The rows of `df` in order within `keys`; `rows` has the columns added so far.

    Null keys are a key as any other. The order should tell all rows of a key apart, else ties fall
    either way. `divided` says whether there are stretches; by default only if a key has over `most` rows.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], most: int = MOST, divided: bool | None = None):
        self.keys, self.order = keys, order
        self.divided = not df.groupBy(*keys).count().where(F.col("count") > most).isEmpty() if divided is None else divided
        if self.divided:
            by = [*map(F.col, keys), *map(F.col, order)]
            sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
            # The number of the task and of the row in it, in one: stretches follow each other as tasks do.
            df = written(sorted_.withColumn(_AT, F.monotonically_increasing_id()).withColumn(_PART, F.shiftright(_AT, 33)))
        self.rows = df

    def _own(self):
        """The window over a stretch (or a whole key) in order."""
        return Window.partitionBy(*self.keys, _PART).orderBy(_AT) if self.divided else Window.partitionBy(*self.keys).orderBy(*self.order)

    def _carried(self, per_part: DataFrame) -> DataFrame:
        """The rows with a column of their stretch: a small table with a row for each stretch."""
        right = per_part.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(self.keys)} | {_PART: "__p"})
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)] + [F.col(_PART) == F.col("__p")]
        return self.rows.join(right, reduce(Column.__and__, same), "left").drop(*[f"__k{i}" for i in range(len(self.keys))], "__p")

    def _stretches_before(self):
        return Window.partitionBy(*self.keys).orderBy(_PART)

    def total(self, value: Column, name: str) -> Scan:
        """Adds the sum of `value` (a null adds nothing) over the rows up to this one."""
        self.rows = self.rows.withColumn("__v", F.coalesce(value, F.lit(0)))
        if self.divided:
            sums = self.rows.groupBy(*self.keys, _PART).agg(F.sum("__v").alias("__s"))
            before = sums.select(*self.keys, _PART, (F.sum("__s").over(self._stretches_before()) - F.col("__s")).alias("__before"))
            self.rows = self._carried(before)
        own = F.sum("__v").over(self._own().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        self.rows = self.rows.withColumn(name, own + F.col("__before") if self.divided else own).drop("__v", "__before")
        return self

    def previous(self, value: Column, k: int, name: str) -> Scan:
        """Adds the values of the k rows before this one, the nearest first."""
        self.rows = self.rows.withColumn("__v", F.struct(value.alias("v")))
        own = F.collect_list("__v").over(self._own().rowsBetween(-k, -1))
        if self.divided:
            # A stretch has a row at least, so the k stretches before have all that matters.
            last = self.rows.withColumn("__n", F.row_number().over(Window.partitionBy(*self.keys, _PART).orderBy(F.desc(_AT)))).where(F.col("__n") <= k)
            tails = last.groupBy(*self.keys, _PART).agg(F.transform(F.array_sort(F.collect_list(F.struct(_AT, "__v"))), lambda x: x["__v"]).alias("tail"))
            before = F.flatten(F.collect_list("tail").over(self._stretches_before().rowsBetween(-k, -1)))
            self.rows = self._carried(tails.select(*self.keys, _PART, before.alias("__before")))
            own = F.concat("__before", own)
        found = F.slice(F.reverse(own), 1, k)
        self.rows = self.rows.withColumn(name, F.transform(found, lambda x: x["v"])).drop("__v", "__before")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop(_PART, _AT)
