"""Connected components by joins, and forests of the links that one task has found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged


def forest(count: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the same components as the links left[i] - right[i] of 0..count-1."""
    parent = np.arange(count)
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        np.minimum.at(parent, before[left], low)
        np.minimum.at(parent, before[right], low)
        parent = parent[parent]
        if np.array_equal(before, parent):
            break
    members = np.flatnonzero(parent != np.arange(count))
    return members, parent[members]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); component is the smallest node reachable.

    Large stars and small stars in turn: every node links its larger neighbours, then its smaller ones, to the smallest
    it knows, until nothing changes. The number of links never grows, and minima are combined before each shuffle.
    Each round is a written table. No links, no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = staged(edges, "links")
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = staged(large, "large-stars")
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = staged(small.union(lowest.select("a", F.col("low").alias("b"))).distinct(), "small-stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)
