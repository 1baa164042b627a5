"""Daily closing prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import TICKER


def daily_close(bars: DataFrame, start: str, end: str, tickers: list[str] | None = None) -> DataFrame:
    """Closes from ``start`` up to, but not on, ``end``.

    Over a stored table the date range and the tickers reach the scan as pushed filters.
    """
    chosen = bars.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    if tickers is not None:
        chosen = chosen.where(F.col(TICKER).isin(tickers))
    return chosen.select(TICKER, "date", "close")


def store_bars(bars: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """The bars as a stored table, dealt by ticker into buckets and sorted by ticker and date, and that table.

    Whatever runs per ticker in order of date reads it without a shuffle and without a sort. Each bucket is one file, so
    choose their number for the number of tickers and the size of the whole. What was there under the name is replaced.
    The order is used with ``QUERY_SETTINGS``; without them the rows are sorted again.
    """
    writer = bars.repartition(buckets, TICKER).write.format("parquet").mode("overwrite").option("path", folder)
    writer.bucketBy(buckets, TICKER).sortBy(TICKER, "date").saveAsTable(name)
    return bars.sparkSession.table(name)
