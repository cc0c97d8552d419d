"""All vectors of one table against all of another, by blocks that Spark deals out.

Both sides fall into blocks by a hash; each pair of blocks is a cell of a grid, a group of its own, and
a cell is one product of matrices. The plan has the same size however many vectors there are, nothing
passes through the driver but two counts, and no task holds more than a block of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block on either side, and rows of a product made at once.
QUERIES, ITEMS, ROWS = 2048, 8192, 1024


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size the unit vectors, and which rows they are; empty and zero ones, and those with a
    missing element, are left out."""
    rows = vectors.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], vectors.type)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(rows), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(rows.flatten(), float("nan")), float)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        own = flat[begin[at][:, None] + np.arange(n)]
        norms = np.sqrt((own * own).sum(axis=1))
        good = norms > 0
        out[n] = own[good] / norms[good][:, None], at[good]
    return out


def cosine_pairs(queries: DataFrame, items: DataFrame, least: float, k: int | None = None, query_block: int = QUERIES, item_block: int = ITEMS) -> DataFrame:
    """(query_id, item_id, score) for queries (query_id, vector) and items (item_id, vector): cosine on
    [0, 1], from `least` on; with `k` the k best items of each query, equal ones by id.

    Vectors of different sizes, empty and zero ones have cosine 0, a score of 0.5. Null vectors are left out.
    """
    queries = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    items = items.where("vector IS NOT NULL").select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    high, wide = max(1, -(-queries.count() // query_block)), max(1, -(-items.count() // item_block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
        return df.select(block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), *df.columns)

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("score", T.DoubleType())])

    def cell(own: pa.Table, all_: pa.Table) -> pa.Table:
        all_ = all_.sort_by("item_id")
        query_ids, item_ids = own.column("query_id").combine_chunks(), all_.column("item_id").combine_chunks()
        left = _units(own.column("vector"))
        found = []
        for first in range(0, all_.num_rows, ROWS):
            part = all_.slice(first, ROWS)
            score = np.full((own.num_rows, part.num_rows), 0.5)
            for n, (units, at) in _units(part.column("vector")).items():
                if n in left:
                    score[np.ix_(left[n][1], at)] = (np.clip(left[n][0] @ units.T, -1, 1) + 1) / 2
            q, i = np.nonzero(score >= least)
            found.append((q, i + first, score[q, i]))
        q, i, s = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in ((0, np.int64), (1, np.int64), (2, float)))
        if k is not None:
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            starts = np.searchsorted(q, q)
            kept = np.arange(len(q)) - starts < k
            q, i, s = q[kept], i[kept], s[kept]
        return pa.table([query_ids.take(pa.array(q)), item_ids.take(pa.array(i)), pa.array(s)], names=["query_id", "item_id", "score"])

    grid = ["__high", "__wide"]
    cells = dealt(queries, *(x for p in zip(grid, (high, wide), strict=True) for x in p)).groupBy(*grid)
    found = cells.cogroup(dealt(items, "__wide", wide, "__high", high).groupBy(*grid)).applyInArrow(lambda a, b: cell(a, b), schema)
    if k is not None:
        # k rows of each cell in a query's line of the grid.
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        found = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    return found
