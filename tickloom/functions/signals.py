"""Numbers to trading signals: 1 buys, -1 sells, 0 holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def three_way(value: Column, low: float, high: float, above: int, below: int) -> Column:
    """``above`` where value > high, ``below`` where value < low, else 0; null counts as 0."""
    return F.when(value > high, F.lit(above)).when(value < low, F.lit(below)).otherwise(F.lit(0))


def mean_reversion_signal(price: Column, average: Column, threshold: float = 0.0005) -> Column:
    """Sell above the moving average, buy below it, by relative distance."""
    return three_way(F.try_divide(price - average, average), -threshold, threshold, above=-1, below=1)


def range_rsi(price: Column, lowest: Column, highest: Column, null_at_high: bool = True) -> Column:
    """Place of the price in its window's range, 0 to 100.

    The formula divides by the distance to the top, so a price at the top has no value. ``null_at_high=False``
    gives 100 there, and null only where the range is empty.
    """
    strength = F.try_divide(price - lowest, highest - price)
    rsi = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength)
    if null_at_high:
        return rsi
    return F.when((price == highest) & (highest > lowest), F.lit(100.0)).otherwise(rsi)


def rsi_signal(rsi: Column, threshold: float = 70) -> Column:
    return three_way(rsi, 100 - threshold, threshold, above=-1, below=1)


def ratio_signal(ratio: Column, threshold: float = 0.0005) -> Column:
    """Buy where the predicted price is above the current one, sell where it is below."""
    return three_way(ratio, 1 - threshold, 1 + threshold, above=1, below=-1)


def consensus(first: Column, second: Column) -> Column:
    """``buy`` or ``sell`` where both signals say so, else ``none``."""
    return (
        F.when((first == 1) & (second == 1), F.lit("buy"))
        .when((first == -1) & (second == -1), F.lit("sell"))
        .otherwise(F.lit("none"))
    )


def position_marker(change: Column) -> Column:
    """``buy`` where a position turned long, ``sell`` where it turned short, else ``none``.

    Positions are 1 or -1, so a turn changes them by 2; the sign alone tells the direction.
    """
    return F.when(change > 0, F.lit("buy")).when(change < 0, F.lit("sell")).otherwise(F.lit("none"))
