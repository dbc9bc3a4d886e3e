"""Vectors as bytes, and grids of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): rows whose id and vector are not null, without null or non-finite components.

    Repeated rows of one vec_id count once, with the smallest vector.
    """
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(finite).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A pandas column of arrays of one length or several, short ones filled up with zeros."""
    parts = [np.asarray(x, dtype) for x in column]
    width = max((len(p) for p in parts), default=0)
    out = np.zeros((len(parts), width), dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def from_bytes(column, dtype) -> np.ndarray:
    return matrix([np.frombuffer(x, dtype) for x in column], dtype)
