"""A full-text index that is kept, not made anew: segments of postings, and a table of who is in which.

An update writes the postings of its texts as a segment of its own, in folders by a hash of the
term, and then moves its texts to that segment in the table of texts, which is the one commit. A posting
counts only if its text is in its segment: older versions of a text, deleted texts and segments
whose update never came to its commit have no live postings. The corpus' statistics go with the
commit, as differences. A search reads the folders of its own terms only. `merge` brings what is
live of many segments into one.

A row of a segment is what a text has of the terms of one folder: lists of terms and of their
counts. They are made text by text, and move once, to their folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import search
from tidemark.plans.components import written
from tidemark.plans.state import VersionedTable, latest

TEXTS = "id string, segment string, dl long, live boolean"
LISTS = "id string, dl long, terms array<string>, tfs array<int>, segment string, part int"


class SegmentedIndex:
    """The index in a folder: texts/ (a VersionedTable), segments/segment=<name>/part=<n>/."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, buckets: int = 32, stem: bool = True):
        self.spark, self.path, self.parts, self.stem = spark, path.rstrip("/"), parts, stem
        self.texts = VersionedTable(spark, f"{self.path}/texts", T._parse_datatype_string(TEXTS), ["id"], buckets)

    def _write(self, postings: DataFrame, segment: str) -> None:
        """Writes postings (term, id, tf, dl), given by rows or as `search.term_lists`."""
        if "terms" not in postings.columns:
            each = postings.withColumn("part", search.term_part(F.col("term"), self.parts)).groupBy("part", "id", "dl")
            postings = each.agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("l")).select("part", "id", "dl", F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs"))
        # Rebalanced: a folder of any size is many tasks' work, none of which orders much.
        postings.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/segments/segment={segment}")

    @staticmethod
    def _counted(notes: dict, old: DataFrame, new: DataFrame) -> dict:
        """The statistics after the rows of the touched buckets have changed."""

        def sums(rows):
            r = rows.where("live AND dl > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
            return r.n, r.total

        (n0, t0), (n1, t1) = sums(old), sums(new)
        return {"n_docs": notes.get("n_docs", 0) + n1 - n0, "total": notes.get("total", 0) + t1 - t0}

    def update(self, batch: DataFrame, id: str = "id", text: str = "text") -> int | None:
        """Inserts and changes texts; a null text deletes. Of rows that share an id the first by text counts."""
        own = batch.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
        if not own.groupBy("id").count().where("count > 1").isEmpty():
            own = written(latest(own, ["id"], [F.col("text").asc_nulls_last()]))
        segment = uuid.uuid4().hex
        self._write(search.term_lists(own, "id", "text", self.stem, self.parts), segment)
        lengths = self._segments().where(F.col("segment") == segment).groupBy("id").agg(F.first("dl").alias("dl"))
        # Texts stay where they are: only ids meet lengths.
        rows = own.select("id", F.col("text").isNotNull().alias("live")).join(lengths, "id", "left").select("id", F.lit(segment).alias("segment"), F.coalesce("dl", F.lit(0)).alias("dl"), "live")
        return self.texts.upsert(rows, notes=self._counted)

    def _segments(self) -> DataFrame:
        folder = self.texts._path(f"{self.path}/segments")
        if not self.texts._fs.exists(folder):
            return self.spark.createDataFrame([], LISTS)
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/segments")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Those of the rows whose text is in their segment. The rows themselves aren't ordered for it."""
        return rows.join(self.texts.read().where("live").select("id", "segment").hint("shuffle_hash"), ["id", "segment"])

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The live postings (term, id, tf, dl), of some terms only the folders that hold them."""
        rows = self._segments()
        if terms is not None:
            rows = rows.where(F.col("part").isin([r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(search.term_part(F.col("term"), self.parts)).distinct().collect()]))  # a query's terms
        each = rows.select("id", "dl", "segment", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").cast("long").alias("tf"), "dl", "segment")
        if terms is not None:
            each = each.where(F.col("term").isin(terms))
        return self._live(each).select("term", "id", "tf", "dl")

    def stats(self) -> DataFrame:
        """(n_docs, avgdl), one row, as the last commit left it."""
        notes = self.texts.notes()
        n, total = notes.get("n_docs", 0), notes.get("total", 0)
        return self.spark.createDataFrame([(n, total / n if n else None)], "n_docs long, avgdl double")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(id, bm25) of the best texts."""
        terms = search.query_terms(query, self.stem)
        return search.top(search.bm25(self.postings(terms), self.stats(), query, "id", self.stem), "bm25", "id", limit)

    def merge(self) -> int | None:
        """Brings all live postings into one segment. A text that changes meanwhile keeps its newer one."""
        segment = uuid.uuid4().hex
        before = self.texts.read().where("live")
        self._write(self._live(self._segments()).drop("segment"), segment)
        moved = before.select("id", F.lit(segment).alias("segment"), "dl", "live", F.col("segment").alias("was"))
        return self.texts.upsert(moved, when=F.col("old.segment") == F.col("new.was"), notes=self._counted)

    def vacuum(self) -> None:
        """Removes the segments that no text is in. Not to be run beside an update."""
        used = {r.segment for r in self.texts.read().where("live").select("segment").distinct().collect()}  # a name for each update since the last merge
        folder = self.texts._path(f"{self.path}/segments")
        for f in self.texts._fs.listStatus(folder) if self.texts._fs.exists(folder) else []:
            if f.getPath().getName().removeprefix("segment=") not in used:
                self.texts._fs.delete(f.getPath(), True)
