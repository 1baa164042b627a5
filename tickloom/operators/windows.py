"""Sliding-window and per-ticker statistics of quotes."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import FEATURES, PRICE, TICKER, TIMESTAMP
from tickloom.sources.messages import FILE_SEQUENCE

# Features of the scoring snapshot that take the newest value; all others are averaged.
NEWEST_FEATURES = ("regular_market_price", "regular_market_change", "regular_market_change_percent")

# Windows are put together from panes in chunks of time this many window lengths long.
WINDOWS_PER_CHUNK = 64

# A frame looks at all panes of a window again for each window. Windows of more panes than this are made of two halves.
FRAME_PANES = 64


# Digits of an order value behind the time: a whole number for one sequence column; for two, PARTITION_DIGITS of the
# first and the rest for the second.
SEQUENCE_DIGITS, PARTITION_DIGITS = 22, 5


def newest_first(sequence: Sequence[str]) -> Column:
    """What orders two quotes of a ticker: time, then the sequence columns for equal times, as one decimal.

    A number of fixed width lets aggregations that look for the newest value hash rather than sort. Numbers that do not
    fit fail: times from the year 2286 on, and with two sequence columns a first one of 100,000 or a second one of 10 to
    the 17th and more, or negative ones.
    """

    def number(value: Column | int) -> Column:
        return (F.lit(value) if isinstance(value, int) else value).cast("decimal(38,0)")

    def power(digits: int) -> Column:
        return F.lit(Decimal(10) ** digits).cast(f"decimal({digits + 1},0)")

    def limited(name: str, digits: int) -> Column:
        value = F.col(name).cast("bigint")
        fits = value.isNull() | ((value >= 0) & (value < 10**digits))
        return F.when(fits, value).otherwise(F.raise_error(F.concat(F.lit(f"no room for {name} "), value.cast("string"))))

    if len(sequence) > 2:
        raise ValueError("at most two sequence columns can be told apart")
    time = F.unix_micros(TIMESTAMP).cast("decimal(17,0)") * power(SEQUENCE_DIGITS - 2) * number(100)
    if not sequence:
        return time.cast("decimal(38,0)")
    if len(sequence) == 1:
        last = F.coalesce(number(F.col(sequence[0])), number(-(2**63)))
    else:
        rest = SEQUENCE_DIGITS - PARTITION_DIGITS
        first = F.coalesce(limited(sequence[0], PARTITION_DIGITS), F.lit(0)).cast("decimal(5,0)")
        last = first * power(rest) + F.coalesce(limited(sequence[1], rest), F.lit(0)).cast("decimal(17,0)")
    return (time.cast("decimal(38,0)") + last.cast("decimal(38,0)")).cast("decimal(38,0)")


def sliding_stats(
    quotes: DataFrame,
    length_seconds: int = 300,
    slide_seconds: int = 10,
    sequence: Sequence[str] = FILE_SEQUENCE,
    watermark: str | None = None,
    use_panes: bool | None = None,
) -> DataFrame:
    """Newest, average, highest and lowest price, and newest second, per ticker and sliding window.

    Columns: ticker_symbol, end, regular_market_price, moving_avg_price, max_price, min_price, timestamp.
    Rows are grouped by the second their quote came in; ties within are settled by ``sequence``.

    With panes, quotes are first aggregated to slide-sized panes, and windows are put together from panes, instead of
    copying every quote length / slide times before the shuffle. Panes need a slide that divides the length, and are
    the default then. A stream has two stateful steps for them: a window may come out one batch later.
    """
    points = quotes.select(
        TICKER,
        F.date_trunc("second", TIMESTAMP).alias("second"),
        newest_first(sequence).alias("place"),
        F.col(PRICE).alias("price"),
    )
    if watermark is not None:
        points = points.withWatermark("second", watermark)
    if use_panes is None:
        use_panes = length_seconds % slide_seconds == 0
    if not use_panes:
        return _from_quotes(points, length_seconds, slide_seconds)
    if length_seconds % slide_seconds:
        raise ValueError("panes need a window length that is a multiple of the slide")
    if quotes.isStreaming:
        return _from_pane_stream(points, length_seconds, slide_seconds)
    return _from_panes(points, length_seconds, slide_seconds)


def _as_stats(windows: DataFrame, end: Column) -> DataFrame:
    return windows.select(
        TICKER, end.alias("end"), PRICE, "moving_avg_price", "max_price", "min_price", F.col("second").alias(TIMESTAMP)
    )


def _from_quotes(points: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    window = F.window("second", f"{length_seconds} seconds", f"{slide_seconds} seconds").alias("window")
    windows = points.groupBy(TICKER, window).agg(
        F.max_by("price", "place").alias(PRICE),
        F.avg("price").alias("moving_avg_price"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
        F.max("second").alias("second"),
    )
    return _as_stats(windows, F.col("window.end"))


def _pane_aggregates() -> list[Column]:
    return [
        F.max_by("price", "place").alias("price"),
        F.max("place").alias("place"),
        F.sum("price").alias("total"),
        F.count("price").alias("n"),
        F.max("price").alias("highest"),
        F.min("price").alias("lowest"),
        F.max("second").alias("second"),
    ]


def _from_pane_stream(points: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    """Two stateful steps: quotes to panes, and closed panes to windows."""
    length, slide = f"{length_seconds} seconds", f"{slide_seconds} seconds"
    panes = points.groupBy(TICKER, F.window("second", slide).alias("pane")).agg(*_pane_aggregates())
    in_pane = F.window_time("pane")
    windows = panes.groupBy(TICKER, F.window(in_pane, length, slide).alias("window")).agg(
        F.max_by("price", "place").alias(PRICE),
        F.try_divide(F.sum("total"), F.sum("n")).alias("moving_avg_price"),
        F.max("highest").alias("max_price"),
        F.min("lowest").alias("min_price"),
        F.max("second").alias("second"),
    )
    return _as_stats(windows, F.col("window.end"))


def _from_panes(points: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    """Quotes to panes by a combining aggregation, and panes to windows by a range frame or, if long, from halves.

    Panes are named by the second they begin at, and a window by that of its last pane. Windows are put together per
    ticker and chunk of time. A chunk has a fixed number of panes, whatever the number of quotes, so no group grows
    with a busy ticker. A pane whose windows reach into the next chunk goes there too.
    """
    reach = length_seconds - slide_seconds
    chunk_seconds = WINDOWS_PER_CHUNK * length_seconds
    second = F.unix_seconds("second")
    begin = (second - F.pmod(second, F.lit(slide_seconds))).alias("begin")
    panes = points.groupBy(TICKER, begin).agg(*_pane_aggregates())

    def chunk_of(seconds: Column) -> Column:
        return F.floor(seconds / chunk_seconds)

    chunks = F.explode(F.sequence(chunk_of(F.col("begin")), chunk_of(F.col("begin") + reach)))
    placed = panes.select("*", chunks.alias("chunk"))
    # A pane opens its own window and the ones up to the next pane, as far as it reaches and the chunk goes.
    group = Window.partitionBy(TICKER, "chunk")
    until = F.least(
        F.col("begin") + reach,
        F.lead("begin").over(group.orderBy("begin")) - slide_seconds,
        (F.col("chunk") + 1) * chunk_seconds - slide_seconds,
    )
    placed = placed.withColumn("until", until)
    together = _from_halves if length_seconds // slide_seconds > FRAME_PANES else _from_frames
    windows = together(placed, length_seconds, slide_seconds)
    windows = windows.where(F.col("last_pane") >= F.col("chunk") * chunk_seconds)
    windows = windows.select("*", F.col("newest.price").alias(PRICE), F.col("newest.second").alias("second"))
    return _as_stats(windows, F.timestamp_seconds(F.col("last_pane") + slide_seconds))


def _from_frames(placed: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    """Each window from a range frame over its panes: work grows with the panes of a window."""
    own = F.col("last_pane") == F.col("begin")
    opened = placed.select(
        "*", F.explode(F.sequence("begin", "until", F.lit(slide_seconds).cast("bigint"))).alias("last_pane")
    )
    frame = Window.partitionBy(TICKER, "chunk").orderBy("last_pane").rangeBetween(slide_seconds - length_seconds, 0)
    newest = F.last(F.when(own, F.struct("price", "second")), ignorenulls=True).over(frame)
    total, n = F.sum(F.when(own, F.col("total"))).over(frame), F.sum(F.when(own, F.col("n"))).over(frame)
    return opened.select(
        TICKER,
        "chunk",
        "last_pane",
        newest.alias("newest"),
        F.try_divide(total, n).alias("moving_avg_price"),
        F.max(F.when(own, F.col("highest"))).over(frame).alias("max_price"),
        F.min(F.when(own, F.col("lowest"))).over(frame).alias("min_price"),
    )


def _from_halves(placed: DataFrame, length_seconds: int, slide_seconds: int) -> DataFrame:
    """Each window from two halves, with the same work whatever the number of its panes.

    Time is cut into blocks of a window's length, so a window is the end of one block and the beginning of the next.
    Running values from a block's beginning give the one half, and running values from its end the other; nothing is
    subtracted. A window is a row at its last pane, for the first, and a row at its first pane, for the second.
    """
    reach, step = length_seconds - slide_seconds, F.lit(slide_seconds).cast("bigint")
    PANE, LAST, FIRST = 0, 1, 2

    def row(kind: int, at: Column, last_pane: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"), last_pane.alias("last_pane"))

    ends = F.transform(F.sequence("begin", "until", step), lambda pane: F.array(row(LAST, pane, pane), row(FIRST, pane - reach, pane)))
    own = row(PANE, F.col("begin"), F.lit(None).cast("bigint"))
    rows = placed.select("*", F.inline(F.concat(F.array(own), F.flatten(ends))))

    def block_of(second: Column) -> Column:
        return F.floor(second / length_seconds)

    # A window that is a whole block has no second half.
    rows = rows.withColumn("block", block_of(F.col("at"))).where((F.col("kind") != FIRST) | (F.col("block") != block_of(F.col("last_pane"))))
    is_pane = F.col("kind") == PANE
    block = Window.partitionBy(TICKER, "chunk", "block")
    forward = block.orderBy(F.asc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = block.orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def running(newest, frame) -> Column:
        def of(name: str, function) -> Column:
            return function(F.when(is_pane, F.col(name))).over(frame).alias(name)

        value = newest(F.when(is_pane, F.struct("price", "second")), ignorenulls=True).over(frame)
        return F.struct(
            value.alias("newest"), of("total", F.sum), of("n", F.sum), of("highest", F.max), of("lowest", F.min)
        )

    halves = rows.select(
        TICKER, "chunk", "kind", "last_pane", running(F.last, forward).alias("until_last"), running(F.first, backward).alias("from_first")
    ).where(~is_pane)
    half = F.when(F.col("kind") == LAST, F.col("until_last")).otherwise(F.col("from_first"))
    halves = halves.select(TICKER, "chunk", "last_pane", "kind", half.alias("half"))
    # The rows of a window lie in one task already.
    return halves.groupBy(TICKER, "chunk", "last_pane").agg(
        F.min_by("half.newest", F.when(F.col("half.newest").isNotNull(), F.col("kind"))).alias("newest"),
        F.try_divide(F.sum("half.total"), F.sum("half.n")).alias("moving_avg_price"),
        F.max("half.highest").alias("max_price"),
        F.min("half.lowest").alias("min_price"),
    )


def feature_snapshot(quotes: DataFrame, sequence: Sequence[str] = FILE_SEQUENCE) -> DataFrame:
    """One row of model features per ticker: newest price and changes, averages of the rest."""
    place = newest_first(sequence)
    quoted = [F.col(f"`{name}`") for name in FEATURES]
    return quotes.groupBy(TICKER).agg(
        *[
            (F.max_by(column, place) if name in NEWEST_FEATURES else F.avg(column)).alias(name)
            for name, column in zip(FEATURES, quoted)
        ]
    )


def latest_quote(quotes: DataFrame, sequence: Sequence[str] = FILE_SEQUENCE) -> DataFrame:
    """The newest quote of each ticker, whole.

    Columns of fixed width are looked up one by one, in a hash aggregation; text has no such form and is sorted.
    """
    place = newest_first(sequence)
    placed = quotes.withColumn("_place", place)
    others = [name for name in quotes.columns if name != TICKER]
    return placed.groupBy(TICKER).agg(*[F.max_by(F.col(f"`{name}`"), "_place").alias(name) for name in others])
