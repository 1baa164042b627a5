"""Quotes and signals as one live stream of messages, each sent on to where its kind belongs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.messages import kind_of_message, multiplex
from tickloom.schemas import PRICE, TICKER, TIMESTAMP
from tickloom.sources.messages import FILE_SEQUENCE
from tickloom.streaming.sinks import Sink

# What the merge does about an input that is silent: its time stands still and the other's repeats are remembered ever
# longer, or time follows the input that is ahead and messages behind it by more than the delay are lost.
WAIT, GO_ON = "min", "max"

# Live interpolation cuts time into this many steps per reach.
STEPS_PER_REACH = 4


def merge_settings(silent_input: str = WAIT) -> dict[str, str]:
    """Settings to start a merged query with."""
    if silent_input not in (WAIT, GO_ON):
        raise ValueError(f"no such rule: {silent_input}")
    return {"spark.sql.streaming.multipleWatermarkPolicy": silent_input}


def live_merge(
    quote_messages: DataFrame, signal_messages: DataFrame, delay: str = "10 minutes", identity: Sequence[str] = FILE_SEQUENCE
) -> DataFrame:
    """Two streams of encoded messages as one with their topic, each message once.

    Each stream has its own watermark, ``delay`` behind its newest message; one watermark of both follows from them as
    ``merge_settings`` says. Brokers deliver some messages twice: of those with the same topic, key, time and
    ``identity`` the first goes on, and is remembered until the watermark has passed it.
    """
    inputs = [messages.withWatermark(TIMESTAMP, delay) for messages in (quote_messages, signal_messages)]
    return multiplex(*inputs).dropDuplicatesWithinWatermark(["topic", "key", TIMESTAMP, *identity])


def dispatch_to(sinks: Mapping[str, Sequence[Sink]]) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: quotes go to the sinks of ``quote`` and signals to those of ``signal``; other messages are dropped."""

    def write(rows: DataFrame, batch_id: int) -> None:
        # Dropped by the sinks' conditions: a condition here would go before the column and parse each message again.
        told = rows.withColumn("kind", kind_of_message()).persist()
        try:
            for kind, targets in sinks.items():
                own = told.where(F.col("kind") == kind).drop("kind")
                for sink in targets:
                    sink.write_batch(own, batch_id)
        finally:
            told.unpersist()

    return write


def interpolate_live(
    prices: DataFrame,
    signals: DataFrame,
    reach_seconds: int = 180,
    delay: str = "10 seconds",
    sequence: Sequence[str] = FILE_SEQUENCE,
) -> DataFrame:
    """Add ``signal_value`` to a stream of signals: the height of the price stream's line at each signal's time.

    As ``operators.series.interpolate_signals``, for prices up to ``reach_seconds`` away: the price at exactly that time,
    else the straight line between the prices around it, else, where one side has none in reach or there is only one,
    the moving average. Time is cut into steps, ``STEPS_PER_REACH`` to a reach. The signals of a step come out once, when
    both streams have passed the step by the reach and ``delay``. Until then state has one row per ticker and step: its
    signals and prices, and the nearest price in reach on either side, so it is bounded by rate and reach. A price meets
    the signals of its own step only, not all of its ticker's.
    """
    step = max(1, int(reach_seconds * 1000) // STEPS_PER_REACH)
    reach = F.expr(f"interval {int(reach_seconds)} seconds")
    # A sliding window is a step and the reach around it. Signals are in the windows whose step is theirs.
    around = F.window(TIMESTAMP, f"{step + 2 * int(reach_seconds) * 1000} milliseconds", f"{step} milliseconds")
    point = F.struct(F.unix_micros(TIMESTAMP).alias("at"), *[F.col(name) for name in sequence], F.col(PRICE).alias("price"))
    points = prices.where(F.col(PRICE).isNotNull()).withColumn("_point", point).select(TICKER, TIMESTAMP, "_point")
    told = signals.withColumn("_signal", F.struct(*signals.columns)).select(TICKER, TIMESTAMP, "_signal")
    rows = points.withWatermark(TIMESTAMP, delay).unionByName(told.withWatermark(TIMESTAMP, delay), allowMissingColumns=True)
    rows = rows.withColumn("_around", around)
    early, late = (F.col(TIMESTAMP) < F.col("_around.start") + reach), (F.col(TIMESTAMP) >= F.col("_around.end") - reach)
    rows = rows.where(F.col("_signal").isNull() | ~(early | late))
    own = F.col("_point")
    steps = rows.groupBy("_around", TICKER).agg(
        F.max(F.when(early, own)).alias("_earlier"),
        F.min(F.when(late, own)).alias("_later"),
        F.collect_list(F.when(~(early | late), own)).alias("_points"),
        F.collect_set("_signal").alias("_signals"),
    )
    met = steps.select("_earlier", "_later", "_points", F.explode("_signals").alias("_signal"))
    at, micros = F.unix_micros(f"_signal.{TIMESTAMP}"), int(reach_seconds) * 1_000_000

    def in_reach(point: Column) -> Column:
        return F.when(F.abs(point["at"] - at) <= micros, point)

    earlier, later = in_reach(F.col("_earlier")), in_reach(F.col("_later"))
    before = F.coalesce(F.array_max(F.filter("_points", lambda point: point["at"] <= at)), earlier)
    after = F.coalesce(F.array_min(F.filter("_points", lambda point: point["at"] >= at)), later)
    number = F.size("_points") + earlier.isNotNull().cast("int") + later.isNotNull().cast("int")
    met = met.select("_signal.*", before.alias("_before"), after.alias("_after"), number.alias("_prices"))
    at, before, after, average = F.unix_micros(TIMESTAMP), F.col("_before"), F.col("_after"), F.col("moving_avg_price")
    share = F.try_divide(at - before["at"], after["at"] - before["at"])
    value = (
        F.when(F.col("_prices") < 2, average)
        .when(after["at"] == at, after["price"])
        .when(before.isNull() | after.isNull(), average)
        .otherwise(before["price"] + (after["price"] - before["price"]) * share)
    )
    return met.select(*signals.columns, value.alias("signal_value"))
