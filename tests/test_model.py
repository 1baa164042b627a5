import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.clean import clean_quotes
from tickloom.plans import model as ml
from tickloom.schemas import FEATURES
from tickloom.sources import samples


def elastic_net(x, y, strength, mix, rounds=3000):
    """Coordinate descent on standardized data: half the mean squared error plus the mixed penalty."""
    mean_x, mean_y, scale_x, scale_y = x.mean(0), y.mean(), x.std(0), y.std()
    kept = scale_x > 0
    xs, ys = (x[:, kept] - mean_x[kept]) / scale_x[kept], (y - mean_y) / scale_y
    strength = strength / scale_y
    weights = np.zeros(xs.shape[1])
    gram, target = xs.T @ xs / len(ys), xs.T @ ys / len(ys)
    for _ in range(rounds):
        for j in range(len(weights)):
            rest = target[j] - gram[j] @ weights + gram[j, j] * weights[j]
            shrunk = np.sign(rest) * max(abs(rest) - strength * mix, 0)
            weights[j] = shrunk / (gram[j, j] + strength * (1 - mix))
    coefficients = np.zeros(x.shape[1])
    coefficients[kept] = weights * scale_y / scale_x[kept]
    return coefficients, mean_y - coefficients @ mean_x


@pytest.fixture(scope="module")
def quotes(spark, sf_dir):
    return clean_quotes(samples.raw_quotes(spark, sf_dir)).persist()


def test_fit_equals_coordinate_descent(spark, quotes):
    """On a label that depends on the features, so that the penalty does not leave a constant."""
    label = 3 * F.col("bid_price") + 0.5 * F.col("eps") - 2 * F.col("market_cap_type") + F.pmod(F.hash("event_id"), F.lit(100)) / 10
    training = quotes.withColumn("label", label).dropna(subset=list(FEATURES))
    data = training.select(*FEATURES, "label").toPandas().to_numpy(float)
    wanted, intercept = elastic_net(data[:, :-1], data[:, -1], 0.1, 0.8)
    model = ml.train_elastic_net(training, max_iter=1000, tol=1e-12)
    table = {row.feature: row.coefficient for row in ml.coefficient_table(spark, model).collect()}
    assert list(table) == [*FEATURES, "intercept"] and len(FEATURES) == 15
    fitted = data[:, :-1] @ np.array([table[name] for name in FEATURES]) + table["intercept"]
    expected = data[:, :-1] @ wanted + intercept
    assert np.abs(wanted).max() > 0.4
    np.testing.assert_allclose(fitted, expected, atol=1e-4 * data[:, -1].std())


def test_label_looks_back_by_default_and_ahead_on_request(quotes):
    back, ahead = ml.training_set(quotes), ml.training_set(quotes, 10)
    tickers = quotes.select("ticker_symbol").distinct().count()
    assert back.count() == ahead.count() == quotes.count() - 10 * tickers
    assert back.columns == [*quotes.columns, "label"]


def test_rules_for_a_missing_feature(spark, quotes):
    complete, everything = quotes.dropna(subset=list(FEATURES)).count(), quotes.count()
    assert ml.assemble(quotes).count() == everything
    assert ml.assemble(quotes, ml.LEAVE_OUT).count() == complete < everything
    assert tuple(ml.missing_features(quotes).first()) == (everything, everything - complete)
    with pytest.raises(Exception, match="null|missing|Vector"):
        ml.assemble(quotes, ml.FAIL).select("features").collect()
    with pytest.raises(ValueError):
        ml.assemble(quotes, "guess")
    cap = FEATURES.index("market_cap")
    hole = ml.assemble(quotes.where("market_cap is null")).select("features").first()
    assert hole.features[cap] == ml.FILL


def test_a_ticker_that_lacks_a_feature_is_not_lost(quotes):
    model = ml.train_elastic_net(ml.training_set(quotes))
    first = quotes.select("ticker_symbol").orderBy("ticker_symbol").first()[0]
    holes = quotes.withColumn("beta", F.when(F.col("ticker_symbol") != first, F.col("beta")))
    for rule, predicted in ((ml.FILL_IN, True), (ml.LEAVE_OUT, False)):
        signals = {row.ticker_symbol: row for row in ml.ols_signal(ml.score(holes, model, missing=rule)).collect()}
        assert len(signals) == quotes.select("ticker_symbol").distinct().count()
        assert (signals[first].prediction is not None) == predicted
        assert predicted or (signals[first].ratio is None and signals[first].ols_signal == 0)


def test_scores_and_signals(spark, quotes):
    model = ml.train_elastic_net(ml.training_set(quotes))
    scored = ml.score(quotes, model)
    assert scored.columns == ["ticker_symbol", "regular_market_price", "prediction", "ratio"]
    assert scored.count() == quotes.select("ticker_symbol").distinct().count()
    signals = ml.ols_signal(scored)
    assert signals.columns == ["ticker_symbol", "timestamp", "regular_market_price", "prediction", "ratio", "ols_signal"]
    wrong = F.when(F.col("ratio") > 1.0005, 1).when(F.col("ratio") < 0.9995, -1).otherwise(0) != F.col("ols_signal")
    assert signals.where(wrong).isEmpty()
    by_hand = F.abs(F.col("ratio") * F.col("regular_market_price") - F.col("prediction")) > 1e-9
    assert signals.where(by_hand).isEmpty()


def test_store_hands_over_the_newest_model(spark, quotes, tmp_path):
    store = ml.ModelStore(spark, str(tmp_path / "store"))
    assert store.newest() is None and store.newest_version() is None
    weak = ml.train_elastic_net(ml.training_set(quotes), reg_param=0.1)
    strong = ml.train_elastic_net(ml.training_set(quotes), reg_param=1000.0)
    store.save(weak, 3)
    store.save(strong, 12)
    assert store.newest_version() == 12 and store.newest().intercept == strong.intercept
    store.save(weak, 12)
    assert store.newest_version() == 12 and store.newest().intercept == weak.intercept


def test_store_takes_a_new_run_for_newer_and_keeps_few(spark, quotes, tmp_path):
    store = ml.ModelStore(spark, str(tmp_path / "store"), kept=3)
    weak, strong = (ml.train_elastic_net(ml.training_set(quotes), reg_param=r) for r in (0.1, 1000.0))
    for version in range(40, 46):
        store.save(weak, version, "old run")
    store.save(strong, 0, "new run")
    assert store.newest_version() == 0 and store.newest().intercept == strong.intercept
    assert len(list((tmp_path / "store" / "models").iterdir())) == 3
    (tmp_path / "store" / "announced" / "slot=0" / "damaged.parquet").write_bytes(b"damaged")
    with pytest.raises(Exception):
        store.newest_version()
