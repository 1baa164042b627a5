"""Moments of training rows: their numbers, and how often the rows are read for them."""

import math

from pyspark.sql import functions as F

from tickloom.plans import model as ml
from tickloom.schemas import FEATURES


def rows_of(spark, number):
    names = [*FEATURES, "label"]
    columns = [(F.pmod(F.xxhash64("id", F.lit(at)), F.lit(1000)) / 7 + F.col("id") * at).alias(name) for at, name in enumerate(names)]
    rows = spark.range(0, number, 1, 3).select(*columns).withColumn("beta", F.lit(0.1))
    return rows.withColumn("eps", F.when(F.pmod(F.hash("eps"), F.lit(5)) != 0, F.col("eps")))


def test_rows_are_read_once(spark):
    rows, seen = rows_of(spark, 500), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    watched = rows.mapInPandas(counted, rows.schema)
    assert ml.training_moments(watched).count() == 136 and seen.value == 500
    model = ml.train_elastic_net(rows)
    ml.optimality(watched, model).collect()
    assert seen.value == 1000


def test_moments_equal_those_of_spark(spark):
    rows = rows_of(spark, 500)
    found = {(row.feature, row.other): row for row in ml.training_moments(rows).collect()}
    rows = rows.fillna(0.0)
    for one, other in (("market_cap", "label"), ("eps", "eps"), ("eps", "bid_price"), ("label", "label")):
        one, other = (one, other) if (one, other) in found else (other, one)
        mean, deviation, correlation = rows.agg(F.avg(one), F.stddev_pop(one), F.corr(one, other)).first()
        row = found[one, other]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(row[2:], (mean, deviation, correlation)))
    assert all((row.correlation is None) == ("beta" in pair) for pair, row in found.items())
    none = ml.training_moments(rows.limit(0)).collect()
    assert len(none) == 136 and all(row["mean"] is None and row.correlation is None for row in none)
