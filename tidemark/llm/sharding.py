"""Balanced shards by sampled splitters.

Keys are (text digest, id, a number of the row): equal texts lie side by side and no two rows
have the same key, so even one text that fills a third of the table can be divided. A
size-weighted sample of keys gives quantile boundaries of many ranges; ranges that turn out
overfull are divided by a denser sample of their own. The ranges' exact bytes, a few hundred
numbers, place each range on the line of all bytes, and a running sum within a range places
each row; shard s holds the s-th equal stretch of that line. Shards differ by no more than one
document's size. Only ids, sizes and digests are shuffled, never the texts.

Defined results: a null text has no bytes and size 1. Repeated rows are rows of their own.
Null ids sort first among equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import staged, text_or_empty

SHARDS = 16
#: Ranges for each shard, sampled keys for each range, and how full a range may be.
RANGES, DRAWS, FULL = 24, 24, 3.0


def _drawn(keyed: DataFrame, rate: float) -> DataFrame:
    """Rows drawn by weight: each byte counts `rate` draws, and w is what a drawn row stands for.

    A row that alone is worth a draw is always drawn, and counts for all of its draws.
    """
    draw = (F.xxhash64("key", F.lit(7)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) < F.col("size") * rate
    return keyed.where(draw).withColumn("w", F.greatest(F.lit(1.0), F.col("size") * rate))


def _cuts(keys: np.ndarray, weights: np.ndarray, want: int) -> np.ndarray:
    """Keys that cut the drawn ones into `want` parts of about equal weight."""
    order = np.argsort(keys)
    line = np.cumsum(weights[order])
    return keys[order][np.searchsorted(line, line[-1] * np.arange(1, want) / want)] if len(keys) else keys


def _splitters(keyed: DataFrame, total: int, want: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Keys that cut `keyed` into `want` ranges or more, and each range's bytes and rows.

    Ranges that are overfull even without their largest row are cut by a denser sample of their
    own, until none is. Samples get denser each time, in the end they are all of a range's rows.
    """
    rate, share = want * DRAWS / max(total, 1), total / want
    first = _drawn(keyed, rate).select("key", "w").toPandas()
    splitters = np.unique(_cuts(first["key"].to_numpy().astype("S48"), first["w"].to_numpy(), want))
    while True:
        # One row a range.
        filled = _ranged(keyed, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("most"), F.count("*").alias("rows")).toPandas().sort_values("range")
        over = filled[filled["bytes"] - filled["most"] > FULL * share]
        if over.empty:
            return splitters, filled
        rate *= 8
        rows = _drawn(_ranged(keyed, splitters).where(F.col("range").isin(over["range"].tolist())), rate).select("range", "key", "w").toPandas()
        parts = dict(zip(over["range"], 2 * np.ceil(over["bytes"] / share).astype(int), strict=True))
        more = [_cuts(own["key"].to_numpy().astype("S48"), own["w"].to_numpy(), parts[r]) for r, own in rows.groupby("range")]
        splitters = np.unique(np.concatenate([splitters, *more]))


def _ranged(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy().astype("S48"), side="right").astype(np.int32))

    return keyed.withColumn("range", place("key"))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots run from 0 in each shard."""
    body = text_or_empty(text)
    digest = F.lpad(F.hex(F.xxhash64(body)), 16, "0")
    # Signed ids in order as hexadecimal digits (others by a digest); the row's number makes equal rows differ.
    number = F.col(id).cast("long") if isinstance(docs.schema[id].dataType, T.IntegralType) else F.when(F.col(id).isNotNull(), F.xxhash64(id))
    ordered = F.coalesce(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    keyed = docs.select(F.col(id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.concat(digest, ordered).alias("key"), F.monotonically_increasing_id().alias("row"))
    keyed = staged(keyed.select("id", "size", "text_crc32", F.concat(F.rpad("key", 32, "-"), F.lpad(F.hex("row"), 16, "0")).alias("key")), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    want = n_shards * RANGES
    splitters, filled = _splitters(keyed, total, want)
    offsets = keyed.sparkSession.createDataFrame(pd.DataFrame({"range": filled["range"].astype("int32"), "bytes_before": (filled["bytes"].cumsum() - filled["bytes"]).astype("int64"), "rows_before": (filled["rows"].cumsum() - filled["rows"]).astype("int64")}), "range int, bytes_before long, rows_before long")
    # One row a range, at most (shards x RANGES) and what overfull ones were divided into.
    line = _ranged(keyed, splitters).join(F.broadcast(offsets), "range")
    w = Window.partitionBy("range").orderBy("key")
    before = F.col("bytes_before") + F.sum("size").over(w) - F.col("size")
    # A row belongs to the stretch in which its middle lies.
    shard = F.least(F.lit(n_shards - 1), F.floor((before + F.col("size") / 2) * n_shards / F.lit(float(max(total, 1))))).cast("int")
    placed = staged(line.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.row_number().over(w) - 1).alias("at")), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> None:
    """The documents (ids must be unique) in folders shard=0, shard=1, ... of Parquet files."""
    placed = assign_shards(docs, n_shards, id, text).select(F.col(id).alias("__id"), "shard", "slot")
    out = docs.drop("shard", "slot").join(placed, F.col(id) == F.col("__id")).drop("__id")
    out.repartition(n_shards * 4, "shard", F.pmod(F.col("slot"), F.lit(4))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
