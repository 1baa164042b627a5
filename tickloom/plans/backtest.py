"""Two-lag regression backtest of many tickers in one job.

Each step takes the rows and their layout (see ``operators.ordered``) and adds columns; ``backtest`` runs them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.signals import position_marker
from tickloom.operators.ordered import ROWS_PER_SEGMENT, Layout, lagged, plan_layout, running_sum
from tickloom.schemas import TICKER

STRATEGIES = (1, 2)
# What each strategy's regression predicts.
TARGETS = {1: "returns", 2: "direction"}


def lay_out(bars: DataFrame, rows_per_segment: int = ROWS_PER_SEGMENT) -> tuple[DataFrame, Layout]:
    """Bars in date order, ready for the steps below. Bars without a ticker are a series of their own."""
    layout = plan_layout(bars, TICKER, ("date",), rows_per_segment)
    return layout.assign(bars), layout


def log_returns(bars: DataFrame, layout: Layout) -> DataFrame:
    """``returns``: logarithm of close over previous close. Days without one are dropped."""
    ratio = F.try_divide("close", "_previous")
    returns = F.nullif(F.log(ratio), F.lit(float("nan")))
    returned = lagged(bars, layout, {"_previous": ("close", 1)}).withColumn("returns", returns)
    return returned.where(F.col("returns").isNotNull()).drop("_previous")


def direction(rows: DataFrame) -> DataFrame:
    """``direction``: sign of the return, 0 when flat."""
    return rows.withColumn("direction", F.signum("returns").cast("int"))


def lag_features(rows: DataFrame, layout: Layout, lags: int = 2) -> DataFrame:
    """``lag_1`` to ``lag_n``: earlier returns. Days that lack one are dropped."""
    names = [f"lag_{i}" for i in range(1, lags + 1)]
    shifted = lagged(rows, layout, {name: ("returns", i) for i, name in enumerate(names, 1)})
    return shifted.dropna(subset=names)


def _two_regressor_fit(target: str) -> dict[str, Column]:
    """Least-squares slopes of the target on lag_1 and lag_2, from moments that Spark sums in parallel.

    Where the lags are linearly dependent, the shortest solution is taken, as a least-squares solver does.
    """
    v1, v2 = F.var_pop("lag_1"), F.var_pop("lag_2")
    both = F.covar_pop("lag_1", "lag_2")
    c1, c2 = F.covar_pop("lag_1", target), F.covar_pop("lag_2", target)
    spread = v1 * v2 - both * both
    trace = v1 + v2
    dependent = spread <= v1 * v2 * 1e-12
    shortest = {
        1: F.try_divide(v1 * c1 + both * c2, trace * trace),
        2: F.try_divide(both * c1 + v2 * c2, trace * trace),
    }
    solved = {1: F.try_divide(c1 * v2 - c2 * both, spread), 2: F.try_divide(c2 * v1 - c1 * both, spread)}
    return {f"b{i}": F.when(dependent, F.coalesce(shortest[i], F.lit(0.0))).otherwise(solved[i]) for i in (1, 2)}


def grouped_ols(features: DataFrame) -> DataFrame:
    """Intercept and slopes of both regressions for every ticker, in one aggregation."""
    fitted = []
    for strategy, target in TARGETS.items():
        slopes = _two_regressor_fit(target)
        intercept = F.avg(target) - slopes["b1"] * F.avg("lag_1") - slopes["b2"] * F.avg("lag_2")
        fitted += [
            intercept.alias(f"intercept_{strategy}"),
            slopes["b1"].alias(f"b1_{strategy}"),
            slopes["b2"].alias(f"b2_{strategy}"),
        ]
    return features.groupBy(TICKER).agg(*fitted)


def positions(features: DataFrame, coefficients: DataFrame, layout: Layout) -> DataFrame:
    """``pos_ols_1``, ``pos_ols_2``: 1 where the fitted value is above 0, else -1."""
    joined = layout.join_per_key(features, coefficients)
    columns = []
    for strategy in STRATEGIES:
        fit = F.col(f"intercept_{strategy}")
        fit = fit + F.col(f"b1_{strategy}") * F.col("lag_1") + F.col(f"b2_{strategy}") * F.col("lag_2")
        columns.append(F.when(fit > 0, F.lit(1)).otherwise(F.lit(-1)).alias(f"pos_ols_{strategy}"))
    return joined.select(*features.columns, *columns)


def strategy_returns(rows: DataFrame) -> DataFrame:
    """``strat_ols_1``, ``strat_ols_2``: position times return."""
    return rows.withColumns({f"strat_ols_{i}": F.col(f"pos_ols_{i}") * F.col("returns") for i in STRATEGIES})


def position_changes(rows: DataFrame, layout: Layout) -> DataFrame:
    """``positions_ols_1``, ``positions_ols_2``: change of the position since the previous day, null on the first."""
    before = lagged(rows, layout, {f"_before_{i}": (f"pos_ols_{i}", 1) for i in STRATEGIES})
    changes = {f"positions_ols_{i}": F.col(f"pos_ols_{i}") - F.col(f"_before_{i}") for i in STRATEGIES}
    return before.withColumns(changes).drop(*[f"_before_{i}" for i in STRATEGIES])


def cumulative_returns(rows: DataFrame, layout: Layout) -> DataFrame:
    """``cum_returns`` and ``cum_strat_ols_*``: growth of one unit since the first day."""
    sources = {"cum_returns": "returns"} | {f"cum_strat_ols_{i}": f"strat_ols_{i}" for i in STRATEGIES}
    summed = running_sum(rows, layout, sources)
    return summed.withColumns({name: F.exp(name) for name in sources})


def trade_markers(rows: DataFrame) -> DataFrame:
    """One row per ticker, date and strategy whose position turned: ``marker`` and the growth to mark it at."""
    marks = F.array(
        *[
            F.struct(
                F.lit(i).alias("strategy"),
                position_marker(F.col(f"positions_ols_{i}")).alias("marker"),
                F.col(f"cum_strat_ols_{i}").alias("cum_return"),
            )
            for i in STRATEGIES
        ]
    )
    return rows.select(TICKER, "date", F.inline(marks)).where(F.col("marker") != "none")


def prepared(bars: DataFrame, layout: Layout, lags: int = 2) -> DataFrame:
    """Returns, direction and lag features of laid-out bars."""
    return lag_features(direction(log_returns(bars, layout)), layout, lags)


def backtest(bars: DataFrame, lags: int = 2, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Close, returns, lags, positions, strategy returns, position changes and growth, per ticker and day.

    The regressions use the first two lags; more lags only shorten the series.
    """
    laid_out, layout = lay_out(bars, rows_per_segment)
    features = layout.settle(prepared(laid_out, layout, lags))
    held = strategy_returns(positions(features, grouped_ols(features), layout))
    return layout.release(cumulative_returns(position_changes(held, layout), layout))
