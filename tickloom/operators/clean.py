"""Raw quote text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import parse
from tickloom.schemas import CLEAN_FIELDS, RAW_FIELDS


def clean_expressions() -> dict[str, Column]:
    """One expression per clean field, over the raw fields."""
    return {
        "regular_market_price": parse.grouped_double(F.col("regular_market_price")),
        "regular_market_change": parse.signed_double(F.col("regular_market_change")),
        "regular_market_change_percent": parse.percent_points(F.col("regular_market_change_percent")),
        "regular_market_previous_close": parse.grouped_double(F.col("regular_market_previous_close")),
        "regular_market_open": parse.grouped_double(F.col("regular_market_open")),
        "bid_price": parse.pair_price(F.col("bid")),
        "bid_size": parse.pair_size(F.col("bid")),
        "ask_price": parse.pair_price(F.col("ask")),
        "ask_size": parse.pair_size(F.col("ask")),
        "regular_market_volume": parse.grouped_long(F.col("regular_market_volume")),
        "average_volume": parse.grouped_long(F.col("average_volume")),
        "market_cap": parse.magnitude_mantissa(F.col("market_cap")),
        "market_cap_type": parse.magnitude_code(F.col("market_cap")),
        "beta": parse.dash_zero_double(F.col("beta")),
        "pe_ratio": parse.dash_zero_double(F.col("pe_ratio")),
        "eps": parse.dash_zero_double(F.col("eps")),
        "1y_target_est": parse.grouped_or_dash_zero(F.col("1y_target_est")),
    }


def clean_quotes(raw: DataFrame, fields: tuple[str, ...] = CLEAN_FIELDS) -> DataFrame:
    """Typed quotes in one projection: no shuffle, and unread raw fields are pruned from the JSON parse.

    Columns that are not raw fields (ticker, timestamp, sequence) pass through in front.
    """
    expressions = clean_expressions()
    passed = [name for name in raw.columns if name not in RAW_FIELDS]
    return raw.select(*passed, *[expressions[name].alias(name) for name in fields])
