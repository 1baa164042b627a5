"""Windows made of two halves against windows made of frames."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import windows
from tickloom.operators.windows import sliding_stats

QUOTES = "ticker_symbol STRING, second LONG, event_id LONG, regular_market_price DOUBLE"


def quotes(spark, seed=1):
    source = random.Random(seed)
    rows = []
    for ticker, start, number, gap in (("A", 0, 300, 40), ("B", -5000, 200, 3), ("C", 100, 1, 1), (None, 7, 60, 900)):
        second = start
        for at in range(number):
            second += source.randrange(gap + 1) * (source.randrange(20) == 0 and 30 or 1)
            price = None if source.randrange(15) == 0 else round(source.uniform(1, 9), 2)
            rows.append((ticker, second, at, price))
    frame = spark.createDataFrame(rows, QUOTES)
    return frame.withColumn("timestamp", F.timestamp_seconds("second")).drop("second").repartition(3)


def shown(stats):
    columns = [F.round(name, 9).alias(name) if kind == "double" else F.col(name) for name, kind in stats.dtypes]
    return sorted(map(tuple, stats.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("length, slide", [(10, 10), (60, 10), (70, 10), (600, 1), (4000, 40)])
def test_halves_give_the_windows_of_frames(spark, monkeypatch, length, slide):
    found = {}
    for panes in (0, 10**6):
        monkeypatch.setattr(windows, "FRAME_PANES", panes)
        found[panes] = shown(sliding_stats(quotes(spark), length, slide))
    direct = shown(sliding_stats(quotes(spark), length, slide, use_panes=False)) if length // slide < 10 else found[0]
    assert found[0] == found[10**6] == direct and len(direct) > 100


def test_halves_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(windows, "FRAME_PANES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sliding_stats(quotes(spark), 600, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # One to make panes and one to bring those of a chunk together, besides the test's own.
    assert plan.count("Exchange hashpartitioning") == 2
