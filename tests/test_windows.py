import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators.windows import WINDOWS_PER_CHUNK, feature_snapshot, latest_quote, newest_first, sliding_stats
from tickloom.plans.signals import gen_signal
from tickloom.schemas import FEATURES
from tickloom.sources import samples

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "ticker_symbol STRING, micros BIGINT, event_id BIGINT, regular_market_price DOUBLE"


def quotes(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("ticker_symbol", F.timestamp_micros("micros").alias("timestamp"), "event_id", "regular_market_price")


def sample_rows(n=600, seed=1):
    """Two tickers, one with nine tenths of the quotes; several quotes share an instant, and some have no price."""
    rng = random.Random(seed)
    base = int(START.timestamp() * 1_000_000)
    rows = []
    for i in range(n):
        at = base + rng.randrange(0, 900_000_000, 250_000)
        price = None if rng.random() < 0.03 else round(rng.uniform(90, 110), 2)
        rows.append(("HOT" if rng.random() < 0.9 else "COLD", at, i, price))
    return rows


def brute_force(rows, length, slide):
    groups = defaultdict(list)
    for ticker, micros, event, price in rows:
        second = micros // 1_000_000
        begin = second // slide * slide
        while begin + length > second:
            groups[ticker, begin + length].append((micros, event, price))
            begin -= slide
    result = {}
    for key, found in groups.items():
        prices = [price for *_, price in found if price is not None]
        result[key] = (
            max(found, key=lambda row: row[:2])[2],
            sum(prices) / len(prices) if prices else None,
            max(prices, default=None),
            min(prices, default=None),
            max(micros for micros, *_ in found) // 1_000_000,
        )
    return result


def as_dict(stats):
    rows = stats.select(
        "ticker_symbol", F.unix_seconds("end").alias("end"), "regular_market_price", "moving_avg_price", "max_price",
        "min_price", F.unix_seconds("timestamp").alias("at"),
    ).collect()
    return {(row[0], row[1]): tuple(row[2:]) for row in rows}


@pytest.mark.parametrize("use_panes", [False, True])
@pytest.mark.parametrize("length,slide", [(300, 10), (60, 60), (120, 40)])
def test_sliding_stats_equal_brute_force(spark, use_panes, length, slide):
    rows = sample_rows()
    got = as_dict(sliding_stats(quotes(spark, rows), length, slide, use_panes=use_panes))
    expected = brute_force(rows, length, slide)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == tuple(None if v is None else pytest.approx(v, abs=1e-9) for v in row), key


def test_input_order_does_not_matter(spark):
    rows = sample_rows()
    shuffled = random.Random(2).sample(rows, len(rows))
    one = as_dict(sliding_stats(quotes(spark, rows).repartition(1)))
    two = as_dict(sliding_stats(quotes(spark, shuffled).repartition(7)))
    assert {key: row[0] for key, row in one.items()} == {key: row[0] for key, row in two.items()}


def test_panes_need_a_slide_that_divides_the_length(spark):
    frame = quotes(spark, sample_rows(10))
    with pytest.raises(ValueError):
        sliding_stats(frame, 100, 30, use_panes=True)
    expected = brute_force(sample_rows(10), 100, 30)
    assert as_dict(sliding_stats(frame, 100, 30)).keys() == expected.keys()


def test_panes_are_the_batch_default_and_combine_before_the_shuffle(spark):
    plan = sliding_stats(quotes(spark, sample_rows(10)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Expand" not in plan
    assert plan.count("partial_max_by") == 1


def test_windows_across_chunks_and_gaps(spark):
    """Quotes around chunk borders, before 1970 too, with gaps longer than a window."""
    chunk = WINDOWS_PER_CHUNK * 60
    rng = random.Random(9)
    seconds = [border * chunk + rng.randrange(-130, 130) for border in (-3, -1, 0, 1, 2, 2, 2, 7) for _ in range(12)]
    rows = [("A" if i % 3 else "B", s * 1_000_000 + i, i, float(i)) for i, s in enumerate(seconds)]
    got = as_dict(sliding_stats(quotes(spark, rows), 60, 10, use_panes=True))
    expected = brute_force(rows, 60, 10)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == tuple(pytest.approx(v, abs=1e-9) for v in row), key


def test_signal_properties(spark, sf_dir):
    hour = 3600
    signals = gen_signal(samples.prices(spark, sf_dir), 6 * hour, hour)
    bad = signals.where(
        ~F.col("rsi_signal").isin(-1, 0, 1) | ~F.col("mac_signal").isin(-1, 0, 1) | ~F.col("rsi").between(0, 100)
    )
    assert signals.count() > 0 and bad.isEmpty()
    stats = sliding_stats(samples.prices(spark, sf_dir), 6 * hour, hour)
    assert stats.where("regular_market_price > max_price OR regular_market_price < min_price").isEmpty()


def test_windows_still_open_are_left_out(spark):
    until = START + timedelta(seconds=400)
    signals = gen_signal(quotes(spark, sample_rows()), as_of=F.timestamp_seconds(F.lit(int(until.timestamp()))))
    newest = signals.agg(F.unix_seconds(F.max("timestamp"))).first()[0]
    assert newest == int(until.timestamp())
    assert gen_signal(quotes(spark, sample_rows())).count() > signals.count()


def test_latest_quote_and_snapshot_take_the_newest(spark):
    base = int(START.timestamp() * 1_000_000)
    rows = [("A", base, 1, 1.0), ("A", base + 5, 2, 2.0), ("A", base + 5, 3, 3.0), ("B", base, 4, None)]
    frame = quotes(spark, rows)
    newest = {row.ticker_symbol: (row.event_id, row.regular_market_price) for row in latest_quote(frame).collect()}
    assert newest == {"A": (3, 3.0), "B": (4, None)}
    others = {name: F.lit(float(i)) + F.col("event_id") for i, name in enumerate(FEATURES[1:], 1)}
    snapshot = {row.ticker_symbol: row for row in feature_snapshot(frame.withColumns(others)).collect()}
    assert snapshot["A"].regular_market_price == 3.0 and snapshot["A"].regular_market_change == 4.0
    assert snapshot["A"].eps == FEATURES.index("eps") + 2.0


def test_newest_values_are_hashed_and_not_sorted(spark, sf_dir):
    from tickloom.plans.queries import comparable_queries

    queries = comparable_queries()
    for name in ("gen_signal", "sliding_stats", "sliding_stats_panes", "latest_quote", "feature_snapshot"):
        plan = queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan, name


def test_as_of_is_filtered_before_the_panes(spark, sf_dir):
    from tickloom.plans.queries import comparable_queries

    plan = comparable_queries()["gen_signal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-25" in plan[plan.index("Scan parquet") :] or "1706140800" in plan[plan.index("Scan parquet") :]


def test_order_of_quotes_as_one_number(spark):
    times = ("timestamp_micros(at) as timestamp",)
    rows = [(1_700_000_000_000_000, 5), (1_700_000_000_000_000, -5), (1_699_999_999_999_999, 2**63 - 1), (1_700_000_000_000_001, -(2**63)), (1, None)]
    frame = spark.createDataFrame(rows, "at BIGINT, event_id BIGINT").selectExpr("*", *times)
    got = [(row.at, row.event_id) for row in frame.orderBy(newest_first(("event_id",))).collect()]
    assert got == sorted(rows, key=lambda row: (row[0], row[1] if row[1] is not None else -(2**63)))
    broker = [(7, 0, 3), (7, 1, 0), (7, 0, 10**17 - 1), (6, 99_999, 5), (8, None, None)]
    frame = spark.createDataFrame(broker, "at BIGINT, partition INT, offset BIGINT").selectExpr("*", *times)
    got = [tuple(row)[:3] for row in frame.orderBy(newest_first(("partition", "offset"))).collect()]
    assert got == sorted(broker, key=lambda row: (row[0], row[1] or 0, row[2] or 0))
    for wrong in ((7, 100_000, 1), (7, 1, 10**17), (7, -1, 1)):
        frame = spark.createDataFrame([wrong], "at BIGINT, partition INT, offset BIGINT").selectExpr("*", *times)
        with pytest.raises(Exception, match="no room"):
            frame.select(newest_first(("partition", "offset"))).collect()
