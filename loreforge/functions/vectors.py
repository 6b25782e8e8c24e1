"""Vector expressions: cosine, centroids and the little-endian float32 codec."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def as_double(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; 0 for vectors of different or no length, or without a norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / norm))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), raw).otherwise(F.lit(0.0))


def literal(vector: Sequence[float]) -> Column:
    """A query vector as one array literal."""
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_to(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine to a fixed vector; whole Arrow batches are scored by one matrix product."""
    fixed = np.asarray(query, np.float64)
    size, norm = len(fixed), float(np.sqrt((fixed * fixed).sum()))

    @pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == size).to_numpy(bool)
        out = np.zeros(len(vectors))
        if fits.any() and norm > 0:
            grid = np.stack(vectors[fits].to_numpy()).astype(np.float64)
            length = np.sqrt((grid * grid).sum(axis=1))
            out[fits] = np.where(length > 0, np.clip(grid @ fixed / np.where(length > 0, length * norm, 1), -1, 1), 0.0)
        return pd.Series(out)

    return score(vector)


def centroid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of each key's vectors in long form: key, idx, mean."""
    parts = df.select(key, F.posexplode(as_double(vector)).alias("idx", "x"))
    return parts.groupBy(key, "idx").agg(F.avg("x").alias("mean"))


def centroid_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key as an array."""
    long = centroid(df, key, vector)
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mean"))), lambda s: s["mean"]).alias("centroid"))


@pandas_udf(BinaryType())
def encode_f32(vectors: pd.Series) -> pd.Series:
    """Array to little-endian float32 bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@pandas_udf(ArrayType(FloatType()))
def decode_f32(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to array; trailing odd bytes are dropped."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))
