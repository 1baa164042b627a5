"""Quotes, messages, pages and bars derived from the sample star-schema tables.

The tables hold no quotes, so their columns are turned into the display text a quote page would show. Spark does
this on the whole tables, and the size of the result follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import PRICE, RAW_FIELDS, TICKER, TIMESTAMP
from tickloom.sources.pages import LISTED_FIELDS, MARKET_ATTRIBUTES, SUMMARY_ATTRIBUTES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events, dealt over all tasks. They may lie in one file of one row group, which a single task reads; the text
    of quotes, its parse and all that follows up to the next shuffle would be that task's too."""
    return table(spark, folder, "events").repartition("event_id", "ts")


def _event_time() -> Column:
    return F.col("ts").cast("timestamp")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def raw_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One raw quote per event: ticker, event_id, timestamp and 14 text fields."""
    k = F.col("k")
    event = F.col("event_id")
    scaled = F.col("value") * 10
    sign = F.when(k >= 50, F.lit("+")).otherwise(F.lit(""))
    volume = F.format_number(F.col("user_id") * 100003 + k, 0)
    letter = F.substring(F.lit("KMBT"), (event % 5 + 1).cast("int"), F.lit(1))

    def dashes_every(step: int, text: Column) -> Column:
        return F.when(event % step == 0, F.lit("--")).otherwise(text)

    fields = {
        "regular_market_price": F.format_number(scaled, 2),
        "regular_market_change": _text(sign, k - 50, ".25"),
        "regular_market_change_percent": _text("(", sign, k - 50, ".5%)"),
        "regular_market_previous_close": F.format_number(scaled + 1, 2),
        "regular_market_open": F.format_number(scaled + 2, 2),
        "bid": dashes_every(17, _text(F.format_number(scaled + 1, 2), " x ", k * 100)),
        "ask": dashes_every(13, _text(F.format_number(scaled + 2, 2), " x ", k * 200)),
        "regular_market_volume": volume,
        "average_volume": volume,
        "market_cap": dashes_every(19, _text(k, ".5", letter)),
        "beta": dashes_every(7, _text("1.", k)),
        "pe_ratio": dashes_every(5, _text(k, ".75")),
        "eps": _text(k - 30, ".5"),
        "1y_target_est": dashes_every(11, F.format_number(scaled + 2, 2)),
    }
    events = spread_events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(
        F.col("event_type").alias(TICKER),
        "event_id",
        _event_time().alias(TIMESTAMP),
        *[fields[name].alias(name) for name in RAW_FIELDS],
    )


def quote_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The raw quotes as key and value JSON, the way a broker delivers them."""
    return raw_quotes(spark, folder).select(
        F.to_json(F.struct(TICKER)).alias("key"),
        F.to_json(F.struct(*RAW_FIELDS)).alias("value"),
        TIMESTAMP,
        "event_id",
    )


def prices(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Ticker, timestamp, event_id and a numeric price per event; with ``spread`` dealt over all tasks."""
    events = spread_events(spark, folder) if spread else table(spark, folder, "events")
    return events.select(
        F.col("event_type").alias(TICKER),
        _event_time().alias(TIMESTAMP),
        "event_id",
        F.col("value").alias(PRICE),
    )


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per order priority and day. The offset keeps daily returns small, as they are in a market."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias(TICKER), F.to_date("o_orderdate").alias("date"))
        .agg((F.lit(100000000.0) + F.avg("o_totalprice")).alias("close"))
    )


def quote_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The raw quotes as HTML. Every fifth page lacks its market cap; each page also shows another symbol."""

    def element(symbol: Column | str, attribute: str, text: Column | str) -> Column:
        return _text('<fin-streamer data-symbol="', symbol, '" ', attribute, ' class="x">', text, "</fin-streamer>")

    quote = raw_quotes(spark, folder)
    tags = []
    for name, mark in (MARKET_ATTRIBUTES | SUMMARY_ATTRIBUTES).items():
        own = element(F.col(TICKER), mark, F.col(name))
        if name == "market_cap":
            own = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(own)
        tags += [element("^INDEX", mark, "0.00"), own]
    places = {place: name for name, place in LISTED_FIELDS.items()}
    items = [
        _text("<li><span>label</span><span>", F.col(places[i]) if i in places else "n/a", "</span></li>")
        for i in range(1, 17)
    ]
    html = F.concat(F.lit("<html><body>"), *tags, F.lit("<ul>"), *items, F.lit("</ul></body></html>"))
    return quote.select(TICKER, "event_id", html.alias("html"))


def event_span(spark: SparkSession, folder: str, steps: int) -> list[tuple[Column, Column]]:
    """The events' time span cut into equal steps, as pairs of bounds: from (included), to (excluded)."""
    span = table(spark, folder, "events").agg(F.min(_event_time()).alias("first"), F.max(_event_time()).alias("last"))
    low, high = span.select(F.unix_micros("first"), F.unix_micros("last")).first()
    edges = [low + (high + 1 - low) * i // steps for i in range(steps)] + [high + 1]
    return [(F.timestamp_micros(F.lit(a)), F.timestamp_micros(F.lit(b))) for a, b in zip(edges, edges[1:])]
