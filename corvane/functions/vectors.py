"""Vectors as arrays: scores, and the bytes that stores keep them in."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def score_batch(query: list[float], vectors: Column) -> Column:
    """The dot products with one query, by one matrix product for each Arrow batch; for wide vectors."""
    q = np.asarray(query, np.float64)

    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(np.stack(batch.to_numpy()).astype(np.float64) @ q if len(batch) else [], dtype=float)

    return F.pandas_udf(score, "double")(vectors)


def from_bytes(blob: Column) -> Column:
    """float32 bytes, little-endian, as an array."""

    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return F.pandas_udf(decode, "array<float>")(blob)


def to_bytes(vector: Column) -> Column:
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(encode, "binary")(vector)
