"""What both vector operators need: usable vectors, equal vectors as one class, and cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE_ROWS = 10_000  # members of a cell or bucket that one task takes


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def exact_cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of rows with rows of the same number; the same for a pair wherever it is computed."""
    norms = np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1))
    return (left * right).sum(axis=1) / norms


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def shares(members: DataFrame, keys: list[str], key_id: str) -> DataFrame:
    """Adds ``shares``, the tasks a group of ``keys`` needs, and ``share``, the one of this row."""
    sizes = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares"))
    return members.join(sizes, keys).withColumn("share", F.pmod(F.xxhash64(key_id), F.col("shares")).cast("int"))
