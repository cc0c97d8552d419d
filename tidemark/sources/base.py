"""What sources share: ids, watermarks, database access, a data source for SQLite files."""

from __future__ import annotations

import sqlite3
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.plans.state import insert_new, latest, merge_df
from tidemark.schemas import KEYS


class Source(Protocol):
    """Raw tables in, ledger tables out; `since` is the last watermark, None for a full sync."""

    def tables(self, since: int | None = None) -> dict[str, DataFrame]: ...


def ledger_id(adapter: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(adapter), *[p.cast("string") for p in parts])


def contact_id(kind: str | Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, normalized), 256)


def missing(column: Column) -> Column:
    """An empty string is a missing value."""
    return F.nullif(column, F.lit(""))


def apply(state: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next version of each table: rows of a batch upserted by their keys."""
    out = dict(state)
    for name, rows in batch.items():
        if name not in KEYS or name not in out:
            out[name] = rows if name not in out else out[name].unionByName(rows, allowMissingColumns=True)
            continue
        key = KEYS[name]
        fresh = latest(rows, key, [F.col(c).asc_nulls_last() for c in sorted(rows.columns)])
        out[name] = insert_new(out[name], fresh, key) if name in ("participants", "tags") else merge_df(out[name], fresh, key, default="new_or_old")
    return out


def summary(before: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Created and updated rows of each table."""
    out = {}
    for name, rows in batch.items():
        if name in KEYS and name in before:
            key = KEYS[name]
            n = rows.select(*key).distinct().count()
            new = rows.select(*key).distinct().join(before[name].select(*key), key, "left_anti").count()
            out[name] = {"created": new, "updated": n - new}
    return out


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 8, **options) -> DataFrame:
    """A table of any database with a driver on the class path, read in parallel by a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        bounds = spark.read.format("jdbc").option("url", url).option("query", f"SELECT MIN({partition_column}) lo, MAX({partition_column}) hi FROM {table}").options(**options).load().first()
        if bounds.lo is not None:
            reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds.lo).option("upperBound", bounds.hi + 1).option("numPartitions", partitions)
    return reader.load()


class SqliteDataSource(DataSource):
    """format("sqlite"): options path, table or query, partitions (by rowid, of a table).

    For store files on a disk that every executor mounts; the schema must be given.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema):
        return _SqliteReader(self.options, schema)


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.query, self.table = options["path"], options.get("query"), options.get("table")
        self.count, self.names = int(options.get("partitions", 4)), schema.fieldNames()

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        if self.query:
            return [_Range(None, None)]
        with self._connect() as db:
            low, high = db.execute(f'SELECT MIN(rowid), MAX(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.count))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        columns = ", ".join(f'"{c}"' for c in self.names)
        with self._connect() as db:
            if self.query:
                rows = db.execute(f"SELECT {columns} FROM ({self.query})")
            else:
                rows = db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))
            yield from rows


def sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteDataSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).load()
