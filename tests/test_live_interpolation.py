"""Live interpolation of dense prices: one row of state per ticker and step, and the prices in reach decide."""

from datetime import datetime, timedelta, timezone

import pytest

from tickloom.session import fresh_folder, session_settings
from tickloom.streaming import live, service
from tickloom.streaming.sinks import file_sink, start_query

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
PRICES = "ticker_symbol STRING, timestamp TIMESTAMP, event_id LONG, regular_market_price DOUBLE"
SIGNALS = "ticker_symbol STRING, timestamp TIMESTAMP, moving_avg_price DOUBLE"
REACH = 60


def by_hand(points, at):
    near = [point for point in points if abs(point[0] - at) <= REACH]
    before, after = [p for p in near if p[0] <= at], [p for p in near if p[0] >= at]
    if len(near) < 2 or not before or not after:
        return after[0][2] if len(near) > 1 and after and after[0][0] == at else -1.0
    (t0, _, v0), (t1, _, v1) = max(before), min(after)
    return v1 if t1 == at else v0 + (v1 - v0) * (at - t0) / (t1 - t0)


def test_dense_prices_share_a_row_of_state(spark):
    folder = fresh_folder(spark, "test")
    points = [(second / 16, number, float(second % 37)) for number, second in enumerate(range(0, 16 * 300))]
    points += [(400.0, 9000, 5.0), (460.0, 9001, 7.0), (520.5, 9002, 9.0), (700.0, 9003, 3.0), (700.0, 9004, 4.0), (900.0, 9005, 8.0)]
    asked = [0.0, 14.03, 15.0, 29.99, 59.999, 60.0, 299.97, 300.0, 340.0, 400.0, 459.0, 460.0, 460.4, 460.5, 580.5, 600.0, 640.0, 700.0, 900.0]
    prices = [(None, START + timedelta(seconds=at), number, price) for at, number, price in points] + [("~", START + timedelta(days=1), 1, 1.0)]
    signals = [(None, START + timedelta(seconds=at), -1.0) for at in asked] + [("~", START + timedelta(days=1), 1.0)]
    with session_settings(spark, service.stateful_settings(2)):
        inputs = []
        for part, (schema, rows) in enumerate(((PRICES, prices), (SIGNALS, signals))):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{part}")
            inputs.append(spark.readStream.schema(schema).parquet(f"{folder}/{part}"))
        valued = live.interpolate_live(*inputs, reach_seconds=REACH)
        query = start_query(valued, "valued", file_sink("valued", f"{folder}/valued"), f"{folder}/checkpoints")
        query.awaitTermination()
        most = max(sum(part.numRowsTotal for part in progress.stateOperators) for progress in query.recentProgress)
    found = {row.timestamp.replace(tzinfo=timezone.utc): row.signal_value for row in spark.read.parquet(f"{folder}/valued").collect()}
    assert len(found) == len(asked)
    for at in asked:
        assert found[START + timedelta(seconds=at)] == pytest.approx(by_hand(points, at)), at
    assert most < 200  # of 4807 prices
