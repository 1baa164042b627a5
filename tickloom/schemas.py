"""Column names and types of every message and table the library reads or writes."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

TICKER = "ticker_symbol"
TIMESTAMP = "timestamp"
PRICE = "regular_market_price"

# The field names of a raw quote message. All of them arrive as display text.
RAW_FIELDS = (
    "regular_market_price",
    "regular_market_change",
    "regular_market_change_percent",
    "regular_market_previous_close",
    "regular_market_open",
    "bid",
    "ask",
    "regular_market_volume",
    "average_volume",
    "market_cap",
    "beta",
    "pe_ratio",
    "eps",
    "1y_target_est",
)

# The numeric columns of a clean quote, in message order.
CLEAN_TYPES = {
    "regular_market_price": "double",
    "regular_market_change": "double",
    "regular_market_change_percent": "double",
    "regular_market_previous_close": "double",
    "regular_market_open": "double",
    "bid_price": "double",
    "bid_size": "int",
    "ask_price": "double",
    "ask_size": "int",
    "regular_market_volume": "bigint",
    "average_volume": "bigint",
    "market_cap": "double",
    "market_cap_type": "int",
    "beta": "double",
    "pe_ratio": "double",
    "eps": "double",
    "1y_target_est": "double",
}
CLEAN_FIELDS = tuple(CLEAN_TYPES)

# Model features: every clean number but the two volumes.
FEATURES = tuple(name for name, kind in CLEAN_TYPES.items() if kind != "bigint")

# What each outgoing message carries.
QUOTE_MESSAGE = (*CLEAN_FIELDS, "timestamp")
SIGNAL_MESSAGE = ("timestamp", "moving_avg_price", "rsi", "mac_signal", "rsi_signal")
OLS_MESSAGE = ("timestamp", "regular_market_price", "prediction", "ratio", "ols_signal")

# Topic names.
RAW_TOPIC = "real-time-stock-data"
CLEAN_TOPIC = "real-time-stock-data-processed"
SIGNAL_TOPIC = "signal-rsi-mac"
OLS_TOPIC = "signal-ols"

KEY_SCHEMA = StructType([StructField(TICKER, StringType())])
RAW_SCHEMA = StructType([StructField(name, StringType()) for name in RAW_FIELDS])

# Messages as they lie in files: what a broker delivers, with event_id in place of partition and offset.
MESSAGE_FILE_SCHEMA = "key STRING, value STRING, timestamp TIMESTAMP, event_id BIGINT"
