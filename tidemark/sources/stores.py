"""Stores as streams: SQLite files that others append to, read from a tuple offset (time, id).

An offset holds, for each store file of a folder, the greatest (time, id) that has been read; a batch
takes what lies after the old tuple up to the new one. Offsets are in the query's checkpoint, so a
restart goes on where the last whole batch ended: no row is read twice, and none is missed that has
a greater tuple than those read before (as every store gives its rows rising times). Only the
greatest tuples pass through the driver; rows are read by tasks, several for a store.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class StoreDataSource(DataSource):
    """format("store"): options path (a folder of store files, or one), table, time, id, pieces
    (tasks for a store and batch). Store files lie on a disk that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "store"

    def streamReader(self, schema):
        return StoreStreamReader(self.options, schema)


class _Piece(InputPartition):
    def __init__(self, store, after, upto, low, high):
        self.store, self.after, self.upto, self.low, self.high = store, after, upto, low, high


class StoreStreamReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.path, self.table = options["path"].removeprefix("file://"), options["table"]
        self.pieces = int(options.get("pieces", 2))
        self.names = schema.fieldNames()
        # A missing time counts as 0; rows without id have no place in the order and are left out.
        self.time, self.id = f'coalesce("{options.get("time", "ts")}", 0)', f'"{options.get("id", "id")}"'

    def _stores(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith((".db", ".sqlite"))) if os.path.isdir(self.path) else []

    def _rows(self, store: str, columns: str, after, upto, more: str = ""):
        """Rows of a store between two tuples; none before the table is there."""
        where, values = [f"{self.id} IS NOT NULL"], []
        for sign, at in ((">", after), ("<=", upto)):
            if at is not None:
                where.append(f"({self.time}, {self.id}) {sign} (?, ?)")
                values += at
        db = sqlite3.connect(f"file:{store}?mode=ro", uri=True, timeout=30)
        try:
            if db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone():
                yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE {" AND ".join(where)} {more}', values)
        finally:
            db.close()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The greatest tuple of each store."""
        tops = {s: next(self._rows(s, f"{self.time}, {self.id}", None, None, f"ORDER BY {self.time} DESC, {self.id} DESC LIMIT 1"), None) for s in self._stores()}
        return {s: list(top) for s, top in tops.items() if top}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for store, upto in sorted(end.items()):
            after = start.get(store)
            if after == upto:
                continue
            low, high = next(self._rows(store, "min(rowid), max(rowid)", after, upto))
            if low is not None:
                step = max(1, -(-(high - low + 1) // self.pieces))
                out += [_Piece(store, after, upto, a, min(high, a + step - 1)) for a in range(low, high + 1, step)]
        return out

    def read(self, partition: _Piece):
        columns = ", ".join(f'"{c}"' for c in self.names)
        return self._rows(partition.store, columns, partition.after, partition.upto, f"AND rowid BETWEEN {int(partition.low)} AND {int(partition.high)}")

    def commit(self, end: dict) -> None:
        """Stores keep their rows."""


def store_stream(spark: SparkSession, path: str, table: str, schema: str, time: str = "ts", id: str = "id", pieces: int = 2) -> DataFrame:
    """The rows of a store's table, and of those that come later, as a stream."""
    spark.dataSource.register(StoreDataSource)
    return spark.readStream.format("store").schema(schema).options(path=path, table=table, time=time, id=id, pieces=str(pieces)).load()
