"""Vector functions over arrays of doubles, JVM-side; blobs only for interchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ, either is empty or a norm is 0."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(0.0)


def query_cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query vector, whose norm is a constant of the plan."""
    norm = float(np.sqrt(np.sum(np.square(np.array(query, float)))))
    if not query or not norm:
        return F.lit(0.0)
    own = F.sqrt(dot(vector, vector))
    inner = dot(vector, F.array(*[F.lit(float(x)) for x in query]))
    return F.when((F.size(vector) == len(query)) & (own > 0), inner / (own * norm)).otherwise(0.0)


def normalize_cosine(score: Column) -> Column:
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)) + 1) / 2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float64 vectors; blobs whose length is no multiple of 8 give null."""
    return blobs.map(lambda b: None if b is None or len(b) % 8 else np.frombuffer(b, "<f8"))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f8").tobytes())
