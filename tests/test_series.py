import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tickloom.operators.series import interpolate_signals, retain_recent

PRICES = "ticker_symbol STRING, second DOUBLE, event_id BIGINT, regular_market_price DOUBLE"
SIGNALS = "ticker_symbol STRING, second DOUBLE, moving_avg_price DOUBLE"


def at(frame):
    micros = F.timestamp_micros((F.col("second") * 1_000_000).cast("bigint"))
    return frame.withColumn("timestamp", micros).drop("second")


def valued(spark, prices, signals, **more):
    rows = interpolate_signals(
        at(spark.createDataFrame(prices, PRICES)), at(spark.createDataFrame(signals, SIGNALS)), **more
    )
    found = rows.select("ticker_symbol", (F.unix_micros("timestamp") / 1_000_000).alias("s"), "signal_value").collect()
    return {(row.ticker_symbol, row.s): row.signal_value for row in found}


def by_hand(prices, second, average):
    series = sorted((s, i, p) for _, s, i, p in prices if p is not None)
    if len(series) < 2:
        return average
    after = bisect_left(series, (second,))
    if after < len(series) and series[after][0] == second:
        return series[after][2]
    before = bisect_right(series, (second, float("inf"))) - 1
    if before < 0 or after >= len(series):
        return average
    (x1, _, y1), (x2, _, y2) = series[before], series[after]
    return y1 + (y2 - y1) * (second - x1) / (x2 - x1)


def test_literal_cases(spark):
    prices = [("A", 10.0, 1, 100.0), ("A", 20.0, 2, 110.0), ("A", 30.0, 3, None), ("A", 40.0, 4, 90.0), ("B", 10.0, 5, 7.0)]
    signals = [("A", s, -1.0) for s in (5.0, 10.0, 12.5, 20.0, 30.0, 40.0, 41.0)] + [("B", 10.0, -2.0), ("C", 1.0, -3.0)]
    assert valued(spark, prices, signals) == {
        ("A", 5.0): -1.0, ("A", 10.0): 100.0, ("A", 12.5): 102.5, ("A", 20.0): 110.0, ("A", 30.0): 100.0,
        ("A", 40.0): 90.0, ("A", 41.0): -1.0, ("B", 10.0): -2.0, ("C", 1.0): -3.0,
    }


@pytest.mark.parametrize("rows_per_segment", [10_000, 60, 33])
def test_equals_search_by_hand_under_skew(spark, rows_per_segment):
    rng = random.Random(5)
    prices = [
        ("HOT" if rng.random() < 0.9 else "COLD", float(rng.randrange(400)), i, None if rng.random() < 0.1 else float(i))
        for i in range(900)
    ]
    # A stretch without prices, wider than a segment, with signals in it.
    prices = [row for row in prices if not 100 <= row[1] < 250]
    signals = [(ticker, x / 2, float(-x)) for ticker in ("HOT", "COLD") for x in range(-10, 820, 3)]
    got = valued(spark, prices, signals, rows_per_segment=rows_per_segment)
    assert len(got) == len(signals)
    for ticker, second, average in signals:
        own = [row for row in prices if row[0] == ticker]
        assert got[ticker, second] == pytest.approx(by_hand(own, second, average), abs=1e-9), (ticker, second)


def test_no_frame_is_computed_anew_for_every_row(spark):
    frame = interpolate_signals(at(spark.createDataFrame([], PRICES)), at(spark.createDataFrame([], SIGNALS)))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan


def test_retention_by_count_and_by_time(spark):
    points = [("A", float(i), i, 1.0) for i in range(300)] + [("B", i / 10, i, 1.0) for i in range(300)]
    rows = retain_recent(at(spark.createDataFrame(points, PRICES)), count=180, seconds=100)
    kept = {row.ticker_symbol: (row.n, row.least) for row in rows.groupBy("ticker_symbol").agg(F.count("*").alias("n"), F.min("event_id").alias("least")).collect()}
    assert kept == {"A": (101, 199), "B": (180, 120)}


def test_default_retention_excludes_a_point_three_minutes_old(spark):
    points = [("A", 0.0, 1, 1.0), ("A", 0.1, 2, 1.0), ("A", 180.0, 3, 1.0)]
    rows = retain_recent(at(spark.createDataFrame(points, PRICES)))
    assert sorted(row.event_id for row in rows.collect()) == [2, 3]


def test_row_limit_comes_before_the_shuffle(spark):
    plan = retain_recent(at(spark.createDataFrame([], PRICES).repartition(2)))._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
