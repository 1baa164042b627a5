"""Elastic-net price model: training set, fit, scoring, and its hand-over from one query to another."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.signals import ratio_signal
from tickloom.operators.ordered import ROWS_PER_SEGMENT, lagged, plan_layout
from tickloom.operators.windows import feature_snapshot
from tickloom.plans.elastic import MOMENTS, ElasticNet, fit, moments
from tickloom.schemas import FEATURES, PRICE, TICKER, TIMESTAMP
from tickloom.sources.messages import FILE_SEQUENCE

# The label is the price this many rows away within the ticker: below 0 earlier, above 0 later.
LABEL_HORIZON = -10

# What becomes of a quote with a missing feature: it stops the work, gets FILL in its place, or is left out and counted.
FAIL, FILL_IN, LEAVE_OUT = "fail", "fill", "leave out"
FILL = 0.0

# A deviation of less than this part of the mean is the rounding of a mean of equal numbers.
ROUNDING = 1e-14

# How many models a store keeps.
KEPT_MODELS = 10


def training_set(
    quotes: DataFrame,
    horizon: int = LABEL_HORIZON,
    sequence: Sequence[str] = FILE_SEQUENCE,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Quotes with ``label``; those without one are dropped.

    The default label looks back. A positive horizon gives a label to forecast.
    """
    layout = plan_layout(quotes, TICKER, (TIMESTAMP, *sequence), rows_per_segment)
    labelled = lagged(layout.assign(quotes), layout, {"label": (PRICE, -horizon)})
    return layout.release(labelled.where(F.col("label").isNotNull()))


def has_all_features() -> Column:
    complete = F.lit(True)
    for name in FEATURES:
        complete = complete & F.col(f"`{name}`").isNotNull()
    return complete


def assemble(rows: DataFrame, missing: str = FILL_IN) -> DataFrame:
    """Add the feature vector. ``missing`` is the rule for rows that lack a feature."""
    if missing not in (FAIL, FILL_IN, LEAVE_OUT):
        raise ValueError(f"no such rule: {missing}")
    if missing == LEAVE_OUT:
        rows = rows.where(has_all_features())
    inputs = {f"_in_{name}": F.col(f"`{name}`").cast("double") for name in FEATURES}
    if missing == FILL_IN:
        inputs = {name: F.coalesce(column, F.lit(FILL)) for name, column in inputs.items()}
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="error")
    return assembler.transform(rows.withColumns(inputs)).drop(*inputs)


def missing_features(rows: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``incomplete``, how many there are and how many lack a feature."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~has_all_features()).alias("incomplete"))


def filled(rows: DataFrame, missing: str = FILL_IN) -> DataFrame:
    """The features as numbers, and the label if there is one, by the rule for rows that lack a feature."""
    if missing not in (FAIL, FILL_IN, LEAVE_OUT):
        raise ValueError(f"no such rule: {missing}")
    if missing == LEAVE_OUT:
        rows = rows.where(has_all_features())
    return rows.withColumns({name: feature_value(name, missing) for name in FEATURES})


def feature_value(name: str, missing: str = FILL_IN) -> Column:
    value = F.col(f"`{name}`").cast("double")
    if missing == FILL_IN:
        return F.coalesce(value, F.lit(FILL))
    return F.coalesce(value, F.raise_error(F.lit(f"{name} is missing"))) if missing == FAIL else value


def train_elastic_net(
    training: DataFrame,
    max_iter: int = 100_000,
    reg_param: float = 0.1,
    elastic_net_param: float = 0.8,
    missing: str = FILL_IN,
    tol: float = 1e-12,
) -> ElasticNet:
    """One model over all tickers. Rows left out for a missing feature are counted in the log.

    One aggregation gives the moments of features and label, a small table however many rows there are, and the fit
    follows from it. Without rows the model is zero throughout.
    """
    if missing == LEAVE_OUT:
        found = missing_features(training).first()
        logging.getLogger(__name__).warning("%d of %d rows left out: a feature is missing", found.incomplete, found.rows)
    model = fitted(training, max_iter, reg_param, elastic_net_param, missing, tol)
    return model or ElasticNet((0.0,) * len(FEATURES), 0.0)


def fitted(
    training: DataFrame,
    max_iter: int = 100_000,
    reg_param: float = 0.1,
    elastic_net_param: float = 0.8,
    missing: str = FILL_IN,
    tol: float = 1e-12,
) -> ElasticNet | None:
    """The model of ``train_elastic_net``, or nothing if there are no rows to fit; goes through the rows once."""
    return fit(moments(filled(training, missing)), reg_param, elastic_net_param, max_iter, tol)


def coefficient_table(spark: SparkSession, model: ElasticNet) -> DataFrame:
    """One row per feature and one for the intercept."""
    return model.table(spark)


def training_moments(training: DataFrame) -> DataFrame:
    """(feature, other, mean, deviation, correlation) of all pairs of features and the label, missing ones filled in.

    Mean and deviation are the feature's. They follow from ``elastic.moments``: one pass over the rows, with products of
    matrices instead of 136 correlations a row. A column that never changes has no correlation; one whose deviation is
    within the rounding of its mean is such. Without rows all numbers are null.
    """
    names, kinds = [*FEATURES, "label"], "feature STRING, other STRING"
    rows = filled(training).withColumn("label", F.coalesce(F.col("label").cast("double"), F.lit(FILL)))
    # One row per pair, asked for once: each of the joins below would go through the rows again.
    found = training.sparkSession.createDataFrame(moments(rows).collect(), MOMENTS).withColumn("deviation", F.sqrt(F.col("comoment") / F.col("n")))
    own = found.where("feature = other").select("feature", "mean", "deviation")
    spread = own.select("feature", F.when(F.col("deviation") > F.abs("mean") * ROUNDING, F.col("deviation")).alias("_spread"))
    pairs = training.sparkSession.createDataFrame([(one, other) for at, one in enumerate(names) for other in names[at:]], kinds)
    every = pairs.join(found.select("feature", "other", "n", "comoment"), ["feature", "other"], "left").join(own, "feature", "left")
    every = every.join(spread, "feature", "left")
    every = every.join(spread.select(F.col("feature").alias("other"), F.col("_spread").alias("_other_spread")), "other", "left")
    correlation = F.nanvl(F.col("comoment") / F.col("n") / F.col("_spread") / F.col("_other_spread"), F.lit(None).cast("double"))
    return every.select("feature", "other", "mean", "deviation", correlation.alias("correlation"))


def optimality(
    training: DataFrame, model: ElasticNet, reg_param: float = 0.1, elastic_net_param: float = 0.8, slack: float = 1e-5
) -> DataFrame:
    """(feature, optimal): whether the objective has no slope in the feature's direction at the fitted coefficients.

    The objective has one optimum, as its square penalty is positive, so coefficients that are all optimal are the fit.
    """
    spark = training.sparkSession
    moments = training_moments(training)
    both = moments.union(
        moments.where("feature != other").select(F.col("other"), F.col("feature"), F.lit(0.0), F.lit(0.0), F.col("correlation"))
    )
    spread = moments.where("feature = other").select(F.col("feature").alias("of"), "deviation")
    label = F.lit(spread.where("of = 'label'").first()["deviation"])
    weights = coefficient_table(spark, model).where("feature != 'intercept'").join(spread, F.col("feature") == F.col("of"))
    weights = weights.select(F.col("feature").alias("of"), (F.col("coefficient") * F.col("deviation") / label).alias("weight"))
    # Correlation with the label, less what the fit explains of it.
    signed = F.when(F.col("other") == "label", F.col("correlation")).otherwise(-F.col("correlation") * F.coalesce("weight", F.lit(0.0)))
    slopes = both.where("feature != 'label'").join(weights, F.col("other") == F.col("of"), "left")
    slopes = slopes.groupBy("feature").agg(F.sum(signed).alias("slope"))
    penalty = F.lit(reg_param) / label
    own = slopes.join(weights, F.col("feature") == F.col("of"))
    rest = F.col("slope") - penalty * (1 - elastic_net_param) * F.col("weight")
    moved = F.abs(rest - penalty * elastic_net_param * F.signum("weight")) <= slack
    still = F.abs(rest) <= penalty * elastic_net_param + slack
    return own.select("feature", F.when(F.abs("weight") > slack, moved).otherwise(still).alias("optimal"))


def score(
    quotes: DataFrame,
    model: ElasticNet,
    sequence: Sequence[str] = FILE_SEQUENCE,
    missing: str = FILL_IN,
) -> DataFrame:
    """Predicted price of each ticker's snapshot, and its ratio to the newest price.

    Every ticker comes out; where rows with a missing feature are to be left out, one has no prediction.
    """
    snapshot = feature_snapshot(quotes, sequence)
    rule = FAIL if missing == FAIL else FILL_IN
    prediction = model.predict([feature_value(name, rule) for name in FEATURES])
    predicted = snapshot.withColumn("prediction", F.when(has_all_features(), prediction) if missing == LEAVE_OUT else prediction)
    return predicted.select(TICKER, PRICE, "prediction", F.try_divide("prediction", PRICE).alias("ratio"))


def ols_signal(scored: DataFrame, as_of: Column | None = None, threshold: float = 0.0005) -> DataFrame:
    """The scores with their signal, stamped ``as_of`` (now, if not given)."""
    stamp = F.current_timestamp() if as_of is None else as_of
    signal = ratio_signal(F.col("ratio"), threshold).alias("ols_signal")
    return scored.select(TICKER, stamp.alias(TIMESTAMP), PRICE, "prediction", "ratio", signal)


class ModelStore:
    """The last few models, in a folder that every executor and every query reaches.

    Models go to numbered slots in turn, so the folder holds ``kept`` of them and no more. A slot is announced, with the
    time, only after its model is stored whole; the newest announcement counts, whatever run it comes from. Storing the
    same batch of the same run again takes its slot again, which makes a repeated batch harmless. A slot is taken again
    only ``kept`` models later, so nobody reads one that is being replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, kept: int = KEPT_MODELS):
        self._spark, self._kept = spark, max(2, kept)
        self._models = f"{folder.rstrip('/')}/models"
        self._announced = f"{folder.rstrip('/')}/announced"

    def _newest(self):
        schema = "run STRING, version BIGINT, stored_at BIGINT, slot INT"
        try:
            announced = self._spark.read.schema(schema).parquet(f"{self._announced}/slot=*")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return announced.orderBy(F.desc("stored_at")).first()

    def save(self, model: ElasticNet, version: int, run: str = "") -> None:
        """Store the model of batch ``version`` of a run, the identity of the query that trains."""
        newest = self._newest()
        slot, stored_at = 0, time.time_ns()
        if newest is not None:
            again = (newest.run, newest.version) == (run, version)
            slot = newest.slot if again else (newest.slot + 1) % self._kept
            stored_at = max(stored_at, newest.stored_at + 1)
        model.table(self._spark).coalesce(1).write.mode("overwrite").parquet(f"{self._models}/{slot}")
        row = (run, version, stored_at, slot)
        announced = self._spark.createDataFrame([row], "run STRING, version BIGINT, stored_at BIGINT, slot INT")
        announced.coalesce(1).write.mode("overwrite").parquet(f"{self._announced}/slot={slot}")

    def newest_version(self) -> int | None:
        newest = self._newest()
        return None if newest is None else newest.version

    def newest(self) -> ElasticNet | None:
        newest = self._newest()
        return None if newest is None else ElasticNet.of_table(self._spark.read.parquet(f"{self._models}/{newest.slot}"))
