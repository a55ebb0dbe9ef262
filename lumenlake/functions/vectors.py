"""Vectors as arrays of floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def decode_vectors(df: DataFrame, col: str) -> DataFrame:
    """Little-endian float32 bytes to an array; null for null and for lengths that are no multiple of four."""

    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4") for b in parts], dtype=object)

    return df.withColumn(col, F.pandas_udf(run, "array<float>")(F.col(col)))


def encode_vectors(df: DataFrame, col: str) -> DataFrame:
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in parts], dtype=object)

    return df.withColumn(col, F.pandas_udf(run, "binary")(F.col(col)))


def angles(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of every row to every pivot, and the rows' lengths; a zero row or pivot is at a right angle to all."""
    size = np.linalg.norm(rows, axis=1)
    both = np.outer(size, np.linalg.norm(pivots, axis=1))
    return np.arccos(np.clip(rows @ pivots.T / np.where(both > 0, both, 1.0), -1, 1)), size
