"""State as pure functions: old rows and new rows to the next version of a table.

Parquet tables are not changed in place. A merge is one full outer join on the key (or, for
whole-row rules, one union and window). A `VersionedTable` keeps its rows in buckets by key, and a
merge reads and writes the buckets that its batch touches, so what it costs follows the batch. A
version is a small file that names each bucket's folder. Versions are numbered, and made whole or
not at all, by one writer only: a writer that finds its number taken merges again onto what the
other one made. So readers never see a half-written table, no crash loses or doubles rows, and a
plan never overwrites what it reads.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a merged column follows from its old value `o` and its new one `n`.
RULES = {
    "new": lambda o, n: n,
    "old": lambda o, n: o,
    "new_or_old": lambda o, n: F.coalesce(n, o),
    "old_or_new": lambda o, n: F.coalesce(o, n),
    "max": lambda o, n: F.greatest(o, n),
    "min": lambda o, n: F.least(o, n),
    "sum": lambda o, n: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
    "or": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
}


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in `order`. Keys are compared null-safe."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def merge_df(state: DataFrame, delta: DataFrame, key: list[str], rules: dict[str, str] | None = None, default: str = "new", when: Column | None = None) -> DataFrame:
    """Insert or update by `key`. delta's keys must be unique (see `latest`).

    `rules` names for columns how old and new combine; the others follow `default`. `when`,
    over columns old.* and new.*, limits which matched rows are updated.
    """
    rules = rules or {}
    o, n = state.alias("old"), delta.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]
    joined = o.withColumn("__o", F.lit(True)).alias("old").join(n.withColumn("__n", F.lit(True)).alias("new"), on, "full_outer")
    both = F.col("old.__o").isNotNull() & F.col("new.__n").isNotNull()
    apply = both if when is None else both & F.coalesce(when, F.lit(False))
    out = []
    for c in state.columns:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}") if c in delta.columns else F.lit(None)
        if c in key:
            merged = F.coalesce(old, new)
        elif c not in delta.columns:
            merged = old
        else:
            merged = F.when(apply, RULES[rules.get(c, default)](old, new)).when(both, old).when(F.col("old.__o").isNotNull(), old).otherwise(new)
        out.append(merged.alias(c))
    return joined.select(*out)


def insert_new(state: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Insert the rows whose key is new; others are left as they are."""
    old = state.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    fresh = delta.join(old, [delta[k].eqNullSafe(old[f"__{k}"]) for k in key], "left_anti")
    return state.unionByName(fresh, allowMissingColumns=True).select(*state.columns)


def replace_for(state: DataFrame, delta: DataFrame, owner: list[str], scope: Column | None = None) -> DataFrame:
    """Delete `state`'s rows (within `scope`) of every owner that delta has, then insert delta."""
    owners = delta.select(*[F.col(k).alias(f"__{k}") for k in owner]).distinct()
    on = [state[k].eqNullSafe(owners[f"__{k}"]) for k in owner]
    if scope is not None:
        on.append(scope)
    return state.join(owners, on, "left_anti").unionByName(delta, allowMissingColumns=True).select(*state.columns)


#: Version files have names of this many digits, so that they sort.
_DIGITS = 20


#: A version's notes, from the last ones and the touched rows before and after.
Notes = Callable[[dict, DataFrame, DataFrame], dict]


class VersionedTable:
    """A table in `buckets` by `key` (one bucket without a key) with numbered versions.

    Folders: data/<write>/bucket=<n>/ hold rows, versions/<number>.json a version each. Works on
    any file system whose rename refuses an existing target; on local disks a hard link does.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, buckets: int = 32):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.buckets = key, buckets if key else 1
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # --- versions ---

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def version(self) -> int | None:
        """The number of the newest version."""
        found = self._versions()
        return found[-1] if found else None

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"buckets": {}, "batches": {}, "notes": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version:0{_DIGITS}d}.json").collect()))

    def _publish(self, version: int, manifest: dict) -> bool:
        """Makes a version, whole and only if nobody else has."""
        folder = f"{self.path}/versions"
        self._fs.mkdirs(self._path(folder))
        temporary, final = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{version:0{_DIGITS}d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            return self._move(temporary, final)
        finally:
            self._fs.delete(temporary, False)

    def _move(self, temporary, final) -> bool:
        """Renames a file unless the target exists, in one step."""
        if self._fs.getUri().getScheme() == "file":
            # A local rename would replace the target; a link refuses to.
            a, b = (unquote(urlparse(p.toUri().toString()).path) for p in (temporary, final))
            try:
                os.link(a, b)
            except FileExistsError:
                return False
            return True
        if self._fs.exists(final):
            return False
        try:
            return bool(self._fs.rename(temporary, final)) and not self._fs.exists(temporary)
        except Exception as e:
            if self._fs.exists(final):
                return False
            raise e

    # --- rows ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        own = [f"{self.path}/{folder}/bucket={b}" for b, folder in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one that is still kept."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def notes(self) -> dict:
        """What the newest version says of itself."""
        return self._manifest(self.version())["notes"]

    def _written(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A fresh folder with the rows by bucket, and the buckets that have any."""
        folder = f"data/{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", self._bucket())
        (typed.repartition("bucket") if self.key else typed).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        return folder, sorted(int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket="))

    def _change(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None, whole: bool = False, notes: Notes | None = None) -> int | None:
        """Publishes `merge(old rows, delta)` for the buckets that delta touches (all, if `whole`).

        `batch` names a writer and its batch's number; a batch that a version already holds is left out.
        `notes` gives the version's notes from the last ones and the touched rows before and after.
        """
        # One small number for each bucket at most.
        touched = None if whole else sorted(r[0] for r in delta.select(self._bucket().alias("b")).distinct().collect())
        while True:
            base = self.version()
            old = self._manifest(base)
            if batch and old["batches"].get(batch[0], -1) >= batch[1]:
                return base
            if touched == [] and not batch:
                return base
            buckets = {} if whole else {b: f for b, f in old["buckets"].items() if int(b) not in touched}
            folder = None
            if touched != []:
                folder, filled = self._written(merge(self._rows(old, touched), delta))
                buckets |= {str(b): folder for b in filled}
            batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
            said = old["notes"]
            if notes and folder:
                said = notes(said, self._rows(old, touched), self._rows({"buckets": {str(b): folder for b in filled}}))
            version = 0 if base is None else base + 1
            if self._publish(version, {"buckets": buckets, "batches": batches, "notes": said}):
                return version
            if folder:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def write(self, df: DataFrame) -> int:
        """Replaces all rows."""
        return self._change(df, lambda old, new: new, None, whole=True)

    def upsert(self, delta: DataFrame, rules: dict[str, str] | None = None, default: str = "new", when: Column | None = None, batch: tuple[str, int] | None = None, notes: Notes | None = None) -> int | None:
        """`merge_df` by the table's key; delta's keys must be unique."""
        return self._change(delta, lambda old, new: merge_df(old, new, self.key, rules, default, when), batch, notes=notes)

    def insert(self, delta: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """`insert_new` by the table's key."""
        return self._change(delta, lambda old, new: insert_new(old, new, self.key), batch)

    def vacuum(self, keep: int = 2, older_than_seconds: float = 86_400) -> None:
        """Removes all versions but the last `keep`, and folders that none of those names and that are older than a writer may take."""
        versions = self._versions()
        named = {f for v in versions[-keep:] for f in self._manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{v:0{_DIGITS}d}.json"), False)
        data = self._path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f.getPath().getName()
            if f"data/{name}" not in named and int(name.split("-")[0]) / 1000 < time.time() - older_than_seconds:
                self._fs.delete(f.getPath(), True)
