"""Labels and models that outlast a micro-batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.clean import clean_quotes
from tickloom.plans import elastic
from tickloom.plans import model as ml
from tickloom.schemas import FEATURES
from tickloom.session import fresh_folder
from tickloom.sources import samples
from tickloom.streaming.state import BatchTable
from tickloom.streaming.training import LabelState, TrainingState


@pytest.fixture(scope="module")
def quotes(spark, sf_dir):
    return clean_quotes(samples.raw_quotes(spark, sf_dir)).persist()


def cut(quotes, number, seed):
    """The quotes in batches of uneven sizes, by time; some are empty."""
    times = [row[0] for row in quotes.select(F.unix_micros("timestamp")).orderBy("timestamp").collect()]
    edges = sorted(random.Random(seed).choices(times, k=number - 1))
    edges = [times[0], *edges, times[-1] + 1]
    micros = F.unix_micros("timestamp")
    return [quotes.where((micros >= low) & (micros < high)) for low, high in zip(edges, edges[1:])]


@pytest.mark.parametrize("horizon", [-10, 3])
def test_labels_of_any_cut_are_those_of_one_table(spark, quotes, horizon):
    wanted = ml.training_set(quotes, horizon).select("event_id", "label", "beta")
    state = LabelState(spark, fresh_folder(spark, "labels"), quotes.schema, horizon)
    found = []
    for at, batch in enumerate(cut(quotes, 5, horizon)):
        for _ in range(1 + at % 2):  # a batch that is taken again gives the same
            rows = [tuple(row) for row in state.label(batch, at).select("event_id", "label", "beta").collect()]
        found += rows
    assert sorted(found, key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_state_stays_small_and_late_quotes_are_left_out(spark, quotes):
    folder = fresh_folder(spark, "labels")
    state = LabelState(spark, folder, quotes.schema)
    first, second = cut(quotes, 2, 5)
    state.label(second, 0).count()
    kept = spark.read.parquet(f"{folder}/batch_id=0")
    assert kept.count() == 10 * quotes.select("ticker_symbol").distinct().count()
    assert state.label(first, 1).isEmpty()
    assert sorted(map(str, spark.read.parquet(f"{folder}/batch_id=1").collect())) == sorted(map(str, kept.collect()))


def test_moments_of_parts_merge_to_those_of_all(spark, quotes):
    training = ml.filled(ml.training_set(quotes)).withColumn("part", F.col("event_id") % 7)
    whole = elastic.moments(training)
    parts = elastic.merged(elastic.moments(training, "part").drop("part"))
    data = training.select(*FEATURES, "label").toPandas().to_numpy()
    names, wanted = [*FEATURES, "label"], np.cov(data.T, bias=True) * len(data)
    for found in (whole, parts):
        for row in found.collect():
            place = names.index(row.feature), names.index(row.other)
            assert row.n == len(data) and row["mean"] == pytest.approx(data[:, place[0]].mean())
            assert row.comoment == pytest.approx(wanted[place], rel=1e-9, abs=1e-6 * np.sqrt(wanted[place[0]][place[0]] * wanted[place[1]][place[1]]))


def test_model_of_the_last_minutes_reads_no_quote_again(spark, quotes):
    state = TrainingState(spark, fresh_folder(spark, "training"), minutes=60 * 24 * 5)
    batches, model = cut(quotes, 4, 8), None
    for at, batch in enumerate(batches):
        model = state.model(batch, at, "run")
    newest = quotes.agg(F.max(F.floor(F.unix_seconds("timestamp") / 60))).first()[0]
    recent = ml.training_set(quotes).where(F.floor(F.unix_seconds("timestamp") / 60) > newest - 60 * 24 * 5)
    wanted = ml.train_elastic_net(recent)
    np.testing.assert_allclose(model.coefficients, wanted.coefficients, rtol=1e-6, atol=1e-9)
    assert model.intercept == pytest.approx(wanted.intercept)
    assert state.model(batches[-1], len(batches) - 1, "run").intercept == pytest.approx(model.intercept)  # repeated
    assert TrainingState(spark, fresh_folder(spark, "training")).model(quotes.limit(0), 0) is None


def test_fit_of_the_library_agrees(spark, quotes):
    from pyspark.ml.regression import LinearRegression

    training = ml.training_set(quotes)
    ours = ml.train_elastic_net(training)
    theirs = LinearRegression(maxIter=3000, regParam=0.1, elasticNetParam=0.8, solver="normal", tol=1e-14).fit(ml.assemble(training).select("features", "label"))
    both = ml.assemble(training).select("features", ours.predict([ml.feature_value(name) for name in FEATURES]).alias("ours"))
    gap = theirs.transform(both).select(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0]
    assert gap < 0.01 * training.select(F.stddev("label")).first()[0]


def test_a_table_of_batches(spark):
    table = BatchTable(spark, fresh_folder(spark, "table"), "a LONG", kept=2)
    for at in range(4):
        assert [row.a for row in table.newest_before(at).collect()] == ([at - 1] if at else [])
        table.write(at, spark.createDataFrame([(at,)], "a LONG"))
    assert sorted(row.a for row in table.rows().collect()) == [2, 3] and [row.a for row in table.before(3).collect()] == [2]
    with pytest.raises(ValueError):
        BatchTable(spark, fresh_folder(spark, "table"), "a LONG", kept=1)
