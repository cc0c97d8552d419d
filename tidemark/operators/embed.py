"""Embedding texts with a plug-in: only what is new or has changed, in batches of bounded size."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.documents import stale_embeddings
from tidemark.plans.components import written
from tidemark.plans.state import VersionedTable, latest

BATCH_ROWS, BATCH_BYTES, TRIES = 100, 1 << 20, 3
ROWS = "target_type string, target_id string, model string, embedding array<double>, dimension int, source_text_hash string"


class Embedder(Protocol):
    """A model that gives a vector for each text. It is sent to the tasks, so it must be picklable."""

    model: str

    def embed(self, texts: list[str]) -> list: ...


def batches_of(texts: list[str], rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of at most `rows` texts and `most_bytes` bytes; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text.encode("utf-8", "surrogatepass"))
        if i > start and (i - start == rows or size + n > most_bytes):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def embedded(texts: DataFrame, embedder: Embedder, batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES, tries: int = TRIES, pause_seconds: float = 1.0) -> DataFrame:
    """Embedding rows (see ROWS) of texts (target_type, target_id, text, source_text_hash).

    A call that fails is made again after a pause that doubles; after `tries` failures the task fails,
    and Spark runs it again. Null texts and blank ones are left out.
    """

    def vectors(own: list[str]) -> list:
        for left in range(tries - 1, -1, -1):
            try:
                out = embedder.embed(own)
                if len(out) != len(own):
                    raise ValueError(f"{len(own)} texts, but {len(out)} vectors")
                return out
            except Exception:
                if not left:
                    raise
                time.sleep(pause_seconds * 2 ** (tries - 1 - left))

    def run(batches):
        for batch in batches:
            text = batch.column(2).to_pylist()
            found = [np.asarray(v, float).tolist() for a, b in batches_of(text, batch_rows, batch_bytes) for v in vectors(text[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([embedder.model] * len(text)), pa.array(found, pa.list_(pa.float64())), pa.array([len(v) for v in found], pa.int32()), batch.column(3)], names=["target_type", "target_id", "model", "embedding", "dimension", "source_text_hash"])

    own = texts.where("trim(text) != ''").select("target_type", F.col("target_id").cast("string").alias("target_id"), "text", "source_text_hash")
    return own.mapInArrow(lambda batches: run(b for b in batches if b.num_rows), ROWS)


def stale(texts: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Texts (target_type, target_id, text), with the hash of each, that have no embedding of the model or one of another text."""
    hashed = texts.withColumn("target_id", F.col("target_id").cast("string")).withColumn("source_text_hash", F.sha2("text", 256)).withColumn("__key", F.struct("target_type", "target_id"))
    known = embeddings.where(F.col("model") == model).select(F.struct("target_type", "target_id").alias("target_id"), "source_text_hash")
    return stale_embeddings(hashed, known, id="__key", hash="source_text_hash").drop("__key")


def embed_stale(texts: DataFrame, table: VersionedTable, embedder: Embedder, **bounds) -> int | None:
    """Brings a table of embeddings up to date with texts (target_type, target_id, text).

    Texts that are as they were are not embedded again. Of texts that share an id the first by hash
    counts. Returns the table's version.
    """
    todo = latest(stale(texts, table.read(), embedder.model), ["target_type", "target_id"], [F.col("source_text_hash")])
    # Written first, so that no call is made twice.
    return table.upsert(written(embedded(todo, embedder, **bounds)))
