"""Embedding near-duplicates with an inverted multi-index.

Independent codebooks on the two halves of unit vectors form a grid of cells, so few centroids give many cells. A vector
is entered into the cells it can share with a link: where two vectors lie within ``reach`` of each other, the point
halfway lies within half of it of both, and both visit the cell of that point. A vector's cells are visited in order of
distance to their boundaries, margins of both halves squared and added, nearest first, until the sum passes the square of
half the reach. That bound holds for every link, so recall is one and not an estimate. Vectors in one cell are then
compared in double precision on the original numbers.

Equal vectors of a label are one class from the start. Cells with many members are split into shares, and pairs of
shares are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.llm.components import components, forest
from tickloom.llm.vectors import exact_cosines, matrix, shares, unit, usable

SAMPLE_ROWS = 20_000  # vectors the codebooks are fitted on; every vector is indexed
CELL_ROWS = 500
MOST_CENTROIDS = 64  # of each half
ROUNDS = 12
SLACK = 1e-9


def codebook(half: np.ndarray, centroids: int, seed: int = 1) -> np.ndarray:
    """k-means; an empty cluster keeps its centroid."""
    random = np.random.default_rng(seed)
    found = half[random.choice(len(half), min(centroids, len(half)), replace=False)]
    for _ in range(ROUNDS):
        near = (-2 * half @ found.T + (found * found).sum(axis=1)).argmin(axis=1)
        sums, sizes = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, half)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return np.unique(found, axis=0)


def margins(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distance of each row to the region of each centroid, at least: to the plane between it and the nearest one."""
    distances = -2 * half @ centroids.T + (centroids * centroids).sum(axis=1)
    near = distances.argmin(axis=1)
    apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))[near]
    gaps = distances - distances.min(axis=1)[:, None]
    return np.divide(gaps, 2 * apart, out=np.zeros_like(gaps), where=apart > 0)


def visited(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], within: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells in multi-sequence order up to the bound, for unit vectors.

    The first half's centroids are taken by rising margin; for each, those of the second half that still fit.
    """
    middle = vectors.shape[1] // 2
    first, second = margins(vectors[:, :middle], books[0]) ** 2, margins(vectors[:, middle:], books[1]) ** 2
    order, bound = np.argsort(first, axis=1), within * within + SLACK
    rows, cells = [], []
    for rank in range(first.shape[1]):
        at = order[:, rank]
        left = bound - first[np.arange(len(first)), at]
        if (left < 0).all():
            break
        row, other = np.nonzero(second <= left[:, None])
        rows.append(row)
        cells.append(at[row] * len(books[1]) + other)
    return np.concatenate(rows), np.concatenate(cells)


def vector_links(classes: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(a, b, linked) of classes (class_id, label, embedding).

    Linked pairs, a < b, have a cosine of ``threshold`` at least; their labels agree. The other pairs are the forests of
    the cells' links: fewer, and with the same components.
    """
    sizes = {row["dim"]: row["n"] for row in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    books = {}
    for dim, rows in sizes.items():
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "class_id").limit(SAMPLE_ROWS)
        sample = unit(matrix(sample.select("embedding").toPandas()["embedding"]))
        centroids = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, MOST_CENTROIDS))
        books[dim] = tuple(codebook(half, centroids) for half in (sample[:, : dim // 2], sample[:, dim // 2 :]))
    within = np.sqrt(2 - 2 * threshold) / 2 + SLACK

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                row, cell = visited(unit(matrix(part["embedding"])), books[dim], within)
                yield part.iloc[row].assign(cell=cell)

    entered = classes.select("class_id", "label", "dim", "embedding").mapInPandas(
        enter, "class_id long, label int, dim int, embedding array<float>, cell long"
    )
    entered = shares(staged(entered, "cells"), ["label", "dim", "cell"], "class_id")
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    paired = entered.withColumn("other", other).select(
        "class_id", "label", "dim", "cell", "embedding", "share",
        F.least("share", "other").alias("low"), F.greatest("share", "other").alias("high"),
    )

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        low, high = cell["low"].iloc[0], cell["high"].iloc[0]
        one, two = cell[cell["share"] == low], cell[cell["share"] == high]
        left, right = matrix(one["embedding"]), matrix(two["embedding"])
        found = [np.empty((0, 2), dtype=np.int64)]
        if len(one) and len(two):
            units, ids, other_ids = unit(right), one["class_id"].to_numpy(), two["class_id"].to_numpy()
            for at in range(0, len(left), 512):
                i, j = np.nonzero(unit(left[at : at + 512]) @ units.T >= threshold - SLACK)
                i += at
                near = (exact_cosines(left[i], right[j]) >= threshold) & (ids[i] != other_ids[j])
                found.append(np.stack([ids[i[near]], other_ids[j[near]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        names, places = np.unique(pairs, return_inverse=True)
        members, roots = forest(len(names), *places.reshape(-1, 2).T)
        every = np.concatenate([pairs, np.stack([names[members], names[roots]], axis=1)])
        return pd.DataFrame(every, columns=["a", "b"]).assign(linked=np.arange(len(every)) < len(pairs))

    keys = ("label", "dim", "cell", "low", "high")
    return paired.groupBy(*keys).applyInPandas(compare, "a long, b long, linked boolean").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows without a label or with a vector that is null, empty, zero or not finite link with nothing. Rows that repeat
    count one by one; vectors of different length do not link. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "embedding", usable(F.col("embedding")).alias("fit"))
    rows = rows.withColumn("fit", F.col("fit") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = rows.where("fit").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("members")
    )
    classes = staged(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    pairs = staged(vector_links(classes, threshold), "vector-links")
    links, found = pairs.where("linked").select("a", "b"), components(pairs.where("not linked"))
    both = links.union(links.select("b", "a"))
    sizes = classes.select(F.col("class_id").alias("b"), "members")
    linked = both.join(sizes, "b").groupBy("a").agg(F.sum("members").alias("others"))
    named = (
        classes.join(linked, F.col("class_id") == F.col("a"), "left")
        .join(found, F.col("class_id") == F.col("node"), "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("embedding").alias("of_embedding"),
            (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    same = F.col("fit") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding"))
    return rows.join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def embeddings_query(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
