"""Rows to outgoing messages, the merge of two message streams, and their dispatch by shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import (
    CLEAN_TOPIC,
    OLS_MESSAGE,
    OLS_TOPIC,
    QUOTE_MESSAGE,
    SIGNAL_MESSAGE,
    SIGNAL_TOPIC,
    TICKER,
)

TOPIC_FIELDS = {CLEAN_TOPIC: QUOTE_MESSAGE, SIGNAL_TOPIC: SIGNAL_MESSAGE, OLS_TOPIC: OLS_MESSAGE}


def encode(rows: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``value`` JSON of the fields and ``key`` JSON of the ticker, behind columns to keep. Null fields are left out of the JSON."""
    return rows.select(
        *keep,
        F.to_json(F.struct(*[F.col(f"`{name}`") for name in fields])).alias("value"),
        F.to_json(F.struct(TICKER)).alias("key"),
    )


def encode_quotes(quotes: DataFrame) -> DataFrame:
    return encode(quotes, QUOTE_MESSAGE)


def encode_signals(signals: DataFrame) -> DataFrame:
    """The price is not part of the value; ``dispatch`` tells signals from quotes by that."""
    return encode(signals, SIGNAL_MESSAGE)


def encode_ols(signals: DataFrame) -> DataFrame:
    return encode(signals, OLS_MESSAGE)


def encode_for_topic(rows: DataFrame, topic: str) -> DataFrame:
    """Encode as the topic asks; rows for an unknown topic stay as they are."""
    fields = TOPIC_FIELDS.get(topic)
    return rows if fields is None else encode(rows, fields)


def multiplex(quote_messages: DataFrame, signal_messages: DataFrame) -> DataFrame:
    """Encoded quotes and signals as one message table with their topic. Model signals are not forwarded."""
    return quote_messages.withColumn("topic", F.lit(CLEAN_TOPIC)).unionByName(
        signal_messages.withColumn("topic", F.lit(SIGNAL_TOPIC))
    )


def kind_of_message() -> Column:
    """A message with a price is a quote, else one with an RSI signal is a signal; null for the rest."""
    is_quote = F.get_json_object("value", "$.regular_market_price").isNotNull()
    is_signal = F.get_json_object("value", "$.rsi_signal").isNotNull()
    return F.when(is_quote, F.lit("quote")).when(is_signal, F.lit("signal"))


def dispatch(messages: DataFrame) -> DataFrame:
    """Add ``kind``: a message with a price is a quote, else one with an RSI signal is a signal; drop the rest."""
    return messages.withColumn("kind", kind_of_message()).where(F.col("kind").isNotNull())
