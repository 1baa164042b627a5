import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans import backtest as bt
from tickloom.session import fresh_folder
from tickloom.sources import samples
from tickloom.sources.bars import daily_close, store_bars

SCHEMA = "ticker_symbol STRING, day INT, close DOUBLE"


def bars(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("ticker_symbol", F.expr("date_add(date'2022-01-01', day)").alias("date"), "close")


def walks():
    rng = np.random.default_rng(11)
    rows = []
    for ticker, n in (("AAA", 200), ("BBB", 40), ("CCC", 6)):
        closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(ticker, i, float(close)) for i, close in enumerate(closes)]
    return rows


def one_ticker(closes):
    """The backtest of one ticker in pandas, with numpy's least squares."""
    frame = pd.DataFrame({"day": range(len(closes)), "close": closes})
    frame["returns"] = np.log(frame.close / frame.close.shift(1))
    frame = frame.dropna(subset="returns")
    frame["direction"] = np.sign(frame.returns).astype(int)
    for i in (1, 2):
        frame[f"lag_{i}"] = frame.returns.shift(i)
    frame = frame.dropna(subset=["lag_1", "lag_2"])
    x = np.column_stack([np.ones(len(frame)), frame.lag_1, frame.lag_2])
    for i, target in ((1, "returns"), (2, "direction")):
        fitted = x @ np.linalg.lstsq(x, frame[target], rcond=None)[0]
        frame[f"pos_ols_{i}"] = np.where(fitted > 0, 1, -1)
        frame[f"strat_ols_{i}"] = frame[f"pos_ols_{i}"] * frame.returns
        frame[f"positions_ols_{i}"] = frame[f"pos_ols_{i}"].diff()
    frame["cum_returns"] = np.exp(frame.returns.cumsum())
    for i in (1, 2):
        frame[f"cum_strat_ols_{i}"] = np.exp(frame[f"strat_ols_{i}"].cumsum())
    return frame


@pytest.mark.parametrize("rows_per_segment", [1000, 20])
def test_equals_pandas(spark, rows_per_segment):
    rows = walks()
    # A day without a close costs two returns.
    rows[50] = ("AAA", 50, None)
    got = bt.backtest(bars(spark, rows), rows_per_segment=rows_per_segment)
    got = got.withColumn("day", F.datediff("date", F.lit("2022-01-01").cast("date"))).toPandas()
    for ticker in ("AAA", "BBB", "CCC"):
        mine = got[got.ticker_symbol == ticker].sort_values("day").reset_index(drop=True)
        wanted = one_ticker([row[2] if row[2] is not None else np.nan for row in rows if row[0] == ticker])
        assert mine.day.tolist() == wanted.day.tolist()
        for name in wanted.columns.drop("day"):
            np.testing.assert_allclose(mine[name].astype(float), wanted[name].astype(float), atol=1e-9, err_msg=name)


def test_lags_that_depend_on_each_other_still_have_a_fit(spark):
    growing = [("FLAT", i, 100.0 * 1.5**i) for i in range(8)]
    single = [("ONE", i, [100.0, 110.0, 121.0, 110.0][i]) for i in range(4)]
    rows = {row.ticker_symbol: row for row in bt.backtest(bars(spark, growing + single)).where("date = '2022-01-04'").collect()}
    assert rows["FLAT"].pos_ols_1 == 1 and rows["ONE"].pos_ols_1 == -1 and rows["ONE"].pos_ols_2 == -1


def test_always_long_earns_the_sum_of_returns(spark):
    laid_out, layout = bt.lay_out(bars(spark, walks()))
    held = bt.log_returns(laid_out, layout).withColumns({"pos_ols_1": F.lit(1), "pos_ols_2": F.lit(-1)})
    grown = bt.cumulative_returns(bt.strategy_returns(held), layout)
    different = (F.abs(F.col("cum_returns") - F.col("cum_strat_ols_1")) > 1e-12) | (
        F.abs(F.col("cum_returns") * F.col("cum_strat_ols_2") - 1) > 1e-9
    )
    assert grown.where(different).isEmpty()
    last = grown.groupBy("ticker_symbol").agg(F.max_by("cum_returns", "date").alias("end"), F.exp(F.sum("returns")).alias("sum"))
    assert last.where("abs(end - sum) > 1e-9").isEmpty()


def test_markers_follow_turns_of_the_position(spark):
    tested = bt.backtest(bars(spark, walks()))
    changes = [row[0] for row in tested.select("positions_ols_1").distinct().collect()]
    assert set(changes) <= {None, -2, 0, 2}
    # A change of exactly 1 never happens, so markers go by the sign.
    assert tested.where("positions_ols_1 = 1 OR positions_ols_1 = -1").isEmpty()
    markers = bt.trade_markers(tested)
    expected = tested.where("positions_ols_1 <> 0").count() + tested.where("positions_ols_2 <> 0").count()
    assert markers.count() == expected > 0
    wrong = markers.alias("m").join(tested.alias("t"), ["ticker_symbol", "date"]).where(
        "(strategy = 1 AND (marker = 'buy') <> (positions_ols_1 = 2)) OR (strategy = 2 AND (marker = 'buy') <> (positions_ols_2 = 2))"
    )
    assert wrong.isEmpty()


def test_daily_close_is_half_open_and_pushed_to_the_scan(spark, tmp_path):
    bars(spark, walks()).write.parquet(str(tmp_path / "bars"))
    chosen = daily_close(spark.read.parquet(str(tmp_path / "bars")), "2022-01-02", "2022-01-04", ["AAA", "BBB"])
    days = [str(row.date) for row in chosen.where("ticker_symbol = 'AAA'").orderBy("date").collect()]
    assert days == ["2022-01-02", "2022-01-03"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThan(date" in plan and "In(ticker_symbo" in plan


def test_bars_without_a_ticker_are_a_series_of_their_own(spark):
    named = bars(spark, walks())
    unnamed = named.where("ticker_symbol = 'AAA'").withColumn("ticker_symbol", F.lit(None).cast("string"))
    for limit in (1_000_000, 20):
        tested = bt.backtest(named.union(unnamed), rows_per_segment=limit)
        columns = [name for name in tested.columns if name != "ticker_symbol"]
        lost, own = tested.where("ticker_symbol is null"), tested.where("ticker_symbol = 'AAA'")
        rounded = [F.round(name, 9).alias(name) if kind == "double" else F.col(name) for name, kind in own.select(columns).dtypes]
        assert lost.count() == own.count() > 0
        assert lost.select(*rounded).exceptAll(own.select(*rounded)).isEmpty()


def test_more_lags_shorten_the_series(spark):
    two, four = (bt.backtest(bars(spark, walks()), lags=n).count() for n in (2, 4))
    assert two - four == 2 * 3


def test_stored_bars_need_no_shuffle_and_no_sort(spark, sf_dir):
    place = fresh_folder(spark, "bars")
    name = place.rpartition("/")[2].replace("-", "_")
    bars = samples.daily_bars(spark, sf_dir)
    stored = store_bars(bars, name, place, 4)
    assert sorted(map(tuple, stored.select(*bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    laid_out, layout = bt.lay_out(stored)
    plan = bt.log_returns(laid_out, layout)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Sort [" not in plan
    counted = stored.groupBy("ticker_symbol").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted
