"""Elastic-net regression from moments: numbers that add up over batches, and from which a fit follows without the rows.

A table of moments has one row per pair of columns. Moments of different rows merge to those of all of them, so a model
of any stretch of time comes from the moments of its parts, and what is too old is left out of the sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schemas import FEATURES

LABEL = "label"
MOMENTS = "feature STRING, other STRING, n LONG, mean DOUBLE, other_mean DOUBLE, comoment DOUBLE"
# Rounds of coordinate descent between two attempts to solve for the coefficients that are not zero.
SWEEPS = 50


@dataclass(frozen=True)
class ElasticNet:
    """Coefficients in the order of ``FEATURES``, and the intercept."""

    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, values: Sequence[Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, value in zip(self.coefficients, values, strict=True):
            total = total + F.lit(weight) * value
        return total

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per feature and one for the intercept."""
        rows = [*zip(FEATURES, map(float, self.coefficients)), ("intercept", float(self.intercept))]
        return spark.createDataFrame(rows, "feature STRING, coefficient DOUBLE")

    @staticmethod
    def of_table(table: DataFrame) -> ElasticNet:
        found = {row.feature: row.coefficient for row in table.collect()}
        return ElasticNet(tuple(found[name] for name in FEATURES), found["intercept"])


def moments(rows: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] feature, other, n, mean, other_mean, comoment) of all pairs of features and the label.

    The comoment is the sum of products of both columns' distances to their means. ``rows`` has the features and the
    label as numbers without nulls, and ``by`` names a column of whole numbers. No rows have no moments.

    136 sums of products a row are one product of matrices for many rows, so tasks hand Arrow batches to numpy and put
    out one set of moments each, which are then merged; as sums in Spark they took twenty times as long.
    """
    names = [*FEATURES, LABEL]
    group = F.lit(0).cast("long") if by is None else F.col(by).cast("long")
    numbers = rows.select(group.alias("_by"), *[F.col(f"`{name}`").cast("double").alias(f"x{at}") for at, name in enumerate(names)])

    def of_task(batches):  # holds nothing of this module, so that workers need not import it
        import numpy
        import pandas

        known = {}
        for batch in batches:
            keys, values = batch["_by"].to_numpy(), batch.iloc[:, 1:].to_numpy(float)
            for key in numpy.unique(keys).tolist():
                own = values[keys == key]
                n, mean = len(own), own.mean(axis=0)
                products = (own - mean).T @ (own - mean)
                if key in known:
                    old, center, before = known[key]
                    apart = mean - center
                    products = products + before + numpy.outer(apart, apart) * (n * old / (n + old))
                    mean, n = center + apart * (n / (n + old)), n + old
                known[key] = n, mean, products
        one, other = numpy.triu_indices(len(names))
        for key, (n, mean, products) in known.items():
            columns = {"feature": [names[at] for at in one], "other": [names[at] for at in other], "n": n}
            columns |= {"mean": mean[one], "other_mean": mean[other], "comoment": products[one, other]}
            yield pandas.DataFrame({"_by": key, **columns})

    found = merged(numbers.mapInPandas(of_task, f"_by LONG, {MOMENTS}"), "_by")
    return found.drop("_by") if by is None else found.withColumnRenamed("_by", by)


def merged(parts: DataFrame, by: str | None = None) -> DataFrame:
    """The moments of all rows that the parts were made of, per ``by``. Means first, then distances to them.

    A part is what a task or a batch has put out, so the window over a pair of columns has as many rows as there are.
    """
    group = [*([] if by is None else [by]), "feature", "other"]
    own = Window.partitionBy(*group)

    def mean(name: str) -> Column:
        return F.sum(F.col("n") * F.col(name)).over(own) / F.sum("n").over(own)

    placed = parts.select("*", mean("mean").alias("_mean"), mean("other_mean").alias("_other"))
    apart = F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("other_mean") - F.col("_other"))
    return placed.groupBy(*group).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.first("_other").alias("other_mean"),
        F.sum(F.col("comoment") + apart).alias("comoment"),
    )


def fit(found: DataFrame, reg_param: float, elastic_net_param: float, max_iter: int = 100_000, tol: float = 1e-12) -> ElasticNet | None:
    """The elastic net of one set of moments, or nothing if there are none.

    Half the mean squared error plus ``reg_param`` times the mixed penalty, over features and label divided by their
    standard deviations; a feature that never changes has no coefficient. ``found`` has one row per pair of columns.
    """
    names, place = [*FEATURES, LABEL], {name: at for at, name in enumerate([*FEATURES, LABEL])}
    rows = found.select("feature", "other", "n", "mean", "comoment").collect()
    if not rows:
        return None
    means, products = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for row in rows:
        one, other = place[row.feature], place[row.other]
        products[one, other] = products[other, one] = row.comoment / row.n
        if one == other:
            means[one] = row.mean
    spread = np.sqrt(np.maximum(np.diag(products), 0))
    used = np.flatnonzero(spread[:-1] > 0)
    coefficients = np.zeros(len(FEATURES))
    if spread[-1] > 0:
        scaled = products / np.outer(np.where(spread > 0, spread, 1), np.where(spread > 0, spread, 1))
        strength = reg_param / spread[-1]
        weights = _solve(
            scaled[np.ix_(used, used)], scaled[used, -1], strength * elastic_net_param, strength * (1 - elastic_net_param), max_iter, tol
        )
        coefficients[used] = weights * spread[-1] / spread[used]
    return ElasticNet(tuple(map(float, coefficients)), float(means[-1] - coefficients @ means[:-1]))


def _solve(gram: np.ndarray, target: np.ndarray, edge: float, ridge: float, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent, which finds the signs, and then the linear equations that hold for these signs.

    Features that nearly agree make descent slow, while the equations are solved at once. The solution is the optimum
    if all signs are as they were and no feature left out has a slope beyond the penalty's edge; else descent goes on.
    """
    weights = np.zeros(len(target))
    for _ in range(-(-max_iter // SWEEPS)):
        before = weights.copy()
        for _ in range(SWEEPS):
            for at in range(len(weights)):
                rest = target[at] - gram[at] @ weights + gram[at, at] * weights[at]
                weights[at] = np.sign(rest) * max(abs(rest) - edge, 0) / (gram[at, at] + ridge)
        active = np.flatnonzero(weights)
        signs = np.sign(weights[active])
        exact = np.zeros(len(weights))
        try:
            exact[active] = np.linalg.solve(gram[np.ix_(active, active)] + ridge * np.eye(len(active)), target[active] - edge * signs)
        except np.linalg.LinAlgError:  # features that agree wholly, without a square penalty: no single optimum
            exact[active] = np.nan
        slopes = np.abs(np.delete(target - gram @ exact, active))
        if np.array_equal(np.sign(exact[active]), signs) and (slopes <= edge + tol).all():
            return exact
        if np.abs(weights - before).max(initial=0) <= tol:
            break
    return weights
