import pytest

from tickloom.functions import signals


def evaluate(spark, schema, rows, column):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i INT, {schema}")
    return [row.value for row in frame.select("i", column(frame).alias("value")).orderBy("i").collect()]


def test_three_way(spark):
    got = evaluate(
        spark, "x DOUBLE", [(None,), (0.1,), (-0.1,), (0.2,), (-0.2,)],
        lambda rows: signals.three_way(rows.x, -0.1, 0.1, above=-1, below=1),
    )
    assert got == [0, 0, 0, -1, 1]


def test_range_rsi(spark):
    rows = [(10.0, 1.0, 10.0), (1.0, 1.0, 10.0), (5.0, 5.0, 5.0), (5.5, 1.0, 10.0), (None, 1.0, 2.0)]
    schema = "p DOUBLE, low DOUBLE, high DOUBLE"
    got = evaluate(spark, schema, rows, lambda r: signals.range_rsi(r.p, r.low, r.high))
    assert got == [None, 0.0, None, pytest.approx(50.0), None]
    got = evaluate(spark, schema, rows, lambda r: signals.range_rsi(r.p, r.low, r.high, null_at_high=False))
    assert got == [100.0, 0.0, None, pytest.approx(50.0), None]


def test_rsi_signal_sells_high_and_buys_low(spark):
    got = evaluate(spark, "x DOUBLE", [(71.0,), (70.0,), (30.0,), (29.0,), (None,)], lambda r: signals.rsi_signal(r.x))
    assert got == [-1, 0, 0, 1, 0]


def test_mean_reversion_signal(spark):
    rows = [(101.0, 100.0), (99.0, 100.0), (100.0, 100.0), (1.0, 0.0), (None, 1.0)]
    got = evaluate(spark, "p DOUBLE, a DOUBLE", rows, lambda r: signals.mean_reversion_signal(r.p, r.a))
    assert got == [-1, 1, 0, 0, 0]


def test_ratio_signal_has_the_opposite_sign(spark):
    rows = [(1.001,), (0.999,), (1.0,), (1.0005,), (None,)]
    assert evaluate(spark, "x DOUBLE", rows, lambda r: signals.ratio_signal(r.x)) == [1, -1, 0, 0, 0]


def test_consensus(spark):
    rows = [(1, 1), (-1, -1), (1, -1), (0, 1), (None, 1)]
    got = evaluate(spark, "a INT, b INT", rows, lambda r: signals.consensus(r.a, r.b))
    assert got == ["buy", "sell", "none", "none", "none"]


def test_position_marker(spark):
    got = evaluate(spark, "x INT", [(2,), (-2,), (0,), (None,)], lambda r: signals.position_marker(r.x))
    assert got == ["buy", "sell", "none", "none"]
