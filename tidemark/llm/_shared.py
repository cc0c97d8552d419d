"""Helpers that the corpus operators share: staging tables and Arrow plumbing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (so any file system Spark knows will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where a session has none and runs in one process (local tests), a temporary one is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_staged: dict[str, str] = {}


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. All of an application's are removed when it ends."""
    root = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"
    if root not in _staged:
        _staged[root] = root
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    Cuts the lineage, so a lost executor costs no more than its own tasks, keeps row
    numbers and samples stable between passes, and turns an aggregate into a plain scan,
    whose join Spark can split at hot keys.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch between Spark and Python. The default of 10,000 means tens of MB of text
#: at once on either side; work goes by row here, so small batches cost nothing.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, unless it has a limit of its own."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


#: Columns that name a row's place: its file and its number there.
PLACE = ("__file", "__row")


#: Plans under which a row's place in its file is a name for it: each row of a file at most once.
_PLACED_PLANS = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _names_rows(df: DataFrame) -> bool:
    """Whether `df` is a scan of files with nothing but projections and filters over it."""
    try:
        if "row_index" not in df.select("_metadata").schema["_metadata"].dataType.fieldNames():
            return False
    except AnalysisException:
        return False
    work = [df._jdf.queryExecution().analyzed()]
    while work:
        plan = work.pop()
        if plan.getClass().getSimpleName() not in _PLACED_PLANS or not plan.deterministic():
            return False
        children = plan.children()
        work += [children.apply(i) for i in range(children.size())]
    return True


def placed(df: DataFrame) -> DataFrame:
    """`df` with `PLACE`, the same in every pass. Rows that don't come straight from Parquet files
    (also those that a join, an explode or a union may have made several of) are staged first."""
    df = df if _names_rows(df) else staged(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


#: Folders over which the places of dropped rows are spread, by file.
DROP_FOLDERS = 256


def without(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the rows of `keyed` (see `placed`) whose places aren't in `gone`.

    The rows themselves, with their texts, don't move: places are written to the shared folder,
    ordered by file, and the task that reads a file looks up those of that file alone.
    """
    bound_batches(keyed.sparkSession)
    file, row = PLACE
    folder = staging_path(keyed.sparkSession, "gone")
    dealt = gone.select(*PLACE).withColumn("folder", F.pmod(F.col(file), F.lit(DROP_FOLDERS)))
    dealt.repartition("folder").sortWithinPartitions("folder", *PLACE).write.partitionBy("folder").parquet(folder)

    def rows_of(number: int) -> np.ndarray:
        store, path = pafs.FileSystem.from_uri(f"{folder}/folder={number % DROP_FOLDERS}")
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return np.empty(0, np.int64)
        found = dataset.dataset(path, filesystem=store, format="parquet")
        return found.to_table([row], filter=dataset.field(file) == number)[row].to_numpy()

    def run(batches):
        at, dropped = None, None
        for batch in batches:
            files, rows = batch[file].to_numpy(), batch[row].to_numpy()
            keep = np.ones(len(files), bool)
            for number in np.unique(files).tolist():
                if number != at:
                    at, dropped = number, rows_of(number)
                own = files == number
                keep[own] = ~np.isin(rows[own], dropped)
            yield batch.filter(pa.array(keep)).select(columns)

    return keyed.select(*columns, *PLACE).mapInArrow(run, T.StructType([keyed.schema[c] for c in columns]))


def map_arrow(df: DataFrame, make, added: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `df` (all, without those that `added` replaces) and computed ones.

    `make()` runs once in each task and gives a function from a RecordBatch to the lists
    or arrays of the added columns, in order.
    """
    bound_batches(df.sparkSession)
    names = {n for n, _ in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in added]))

    def run(batches):
        compute = make()
        for batch in batches:
            for piece in halved(batch):
                cols = compute(piece)
                kept = [piece.column(piece.schema.get_field_index(c)) for c in keep]
                new = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + new, names=keep + arrow.names)

    return df.mapInArrow(run, schema)


def halved(batch: pa.RecordBatch, most_bytes: int = 8 << 20):
    """The batch in pieces of about `most_bytes` at most (a single long row stays whole)."""
    if batch.num_rows > 1 and batch.get_total_buffer_size() and batch.nbytes > most_bytes:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), most_bytes)
        yield from halved(batch.slice(half), most_bytes)
    elif batch.num_rows:
        yield batch


def strings(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def put_aside(docs: DataFrame, *needed: str) -> DataFrame:
    """`needed` columns and all others in one, `__row`, where their names can't clash."""
    others = [F.col(c) for c in docs.columns if c not in needed]
    return docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("__row"), *needed)


def restored(df: DataFrame, columns: list[str], needed: tuple[str, ...]) -> DataFrame:
    """The columns as they were before `put_aside`."""
    return df.select(*[F.col(c) if c in needed else F.col("__row")[c].alias(c) for c in columns])
