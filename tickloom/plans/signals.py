"""Mean-reversion and range-RSI signals over sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.signals import mean_reversion_signal, range_rsi, rsi_signal
from tickloom.operators.windows import sliding_stats
from tickloom.schemas import PRICE, TICKER, TIMESTAMP
from tickloom.sources.messages import FILE_SEQUENCE


def gen_signal(
    quotes: DataFrame,
    length_seconds: int = 300,
    slide_seconds: int = 10,
    average_threshold: float = 0.0005,
    rsi_threshold: float = 70,
    as_of: Column | None = None,
    sequence: Sequence[str] = FILE_SEQUENCE,
    watermark: str | None = None,
    use_panes: bool | None = None,
    null_at_high: bool = True,
) -> DataFrame:
    """One row per ticker and window that has ended by ``as_of`` (now, if not given), stamped with its end.

    The same call serves tables and streams; a stream also needs ``watermark``, and emits a window once the
    watermark passes its end.
    """
    if as_of is not None and not quotes.isStreaming:
        quotes = quotes.where(F.col(TIMESTAMP) < as_of)  # no window that ends by then holds a later quote
    stats = sliding_stats(quotes, length_seconds, slide_seconds, sequence, watermark, use_panes)
    ended = stats.where(F.col("end") <= (F.current_timestamp() if as_of is None else as_of))
    price, average = F.col(PRICE), F.col("moving_avg_price")
    scored = ended.select(
        TICKER,
        F.col("end").alias(TIMESTAMP),
        PRICE,
        "moving_avg_price",
        range_rsi(price, F.col("min_price"), F.col("max_price"), null_at_high).alias("rsi"),
        mean_reversion_signal(price, average, average_threshold).alias("mac_signal"),
    )
    return scored.select(
        TICKER,
        TIMESTAMP,
        PRICE,
        "moving_avg_price",
        "rsi",
        rsi_signal(F.col("rsi"), rsi_threshold).alias("rsi_signal"),
        "mac_signal",
    )
