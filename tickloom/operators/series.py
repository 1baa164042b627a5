"""Time series per ticker: interpolation of signals between prices, and a recent stretch of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import ROWS_PER_SEGMENT, Layout, plan_layout
from tickloom.schemas import PRICE, TICKER, TIMESTAMP
from tickloom.session import fresh_folder
from tickloom.sources.messages import FILE_SEQUENCE

# How much of a series a chart keeps, in points and in seconds.
RECENT_POINTS = 180
RECENT_SECONDS = 179.9


def interpolate_signals(
    prices: DataFrame,
    signals: DataFrame,
    sequence: Sequence[str] = FILE_SEQUENCE,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Add ``signal_value``: the price line's height at each signal's time.

    It is the price at exactly that time, else the straight line between the prices around it, else, where one side
    has no price or the ticker has a single one, the signal's moving average.

    Prices and signals are stored as one table, so that neither is computed twice, and sorted together once in each
    direction; each signal takes the last price seen. One shuffle, no range join. Both passes read running frames: a
    frame that ends at the partition's end would be computed anew for every row.
    """
    spark = prices.sparkSession
    prices = prices.where(F.col(PRICE).isNotNull()).select(TICKER, TIMESTAMP, *sequence, PRICE)
    types = dict(prices.dtypes)
    point = F.struct(F.unix_micros(TIMESTAMP).alias("at"), F.col(PRICE).alias("price"))
    price_points = prices.select(TICKER, TIMESTAMP, *sequence, F.lit(0).alias("_kind"), point.alias("_point"))
    signal_points = signals.select(
        TICKER, TIMESTAMP, *[F.lit(None).cast(types[name]).alias(name) for name in sequence],
        F.lit(1).alias("_kind"), F.struct(*signals.columns).alias("_signal"),
    )
    points = price_points.unionByName(signal_points, allowMissingColumns=True)
    folder = fresh_folder(spark, "points")
    points.write.parquet(folder)
    points = spark.read.schema(points.schema).parquet(folder)
    # Signals count as well: a ticker can have far more of them than prices.
    layout = plan_layout(points, TICKER, (TIMESTAMP, *sequence), rows_per_segment)
    points = layout.assign(points)
    price_points = points.where("_kind = 0")

    running = (Window.unboundedPreceding, Window.currentRow)
    keys = Window.partitionBy(layout.by)
    # Of several prices at one time, the backward pass ends with the first and the forward pass with the last.
    forward = keys.orderBy(F.asc(TIMESTAMP), F.asc("_kind"), *[F.asc(name) for name in sequence])
    backward = keys.orderBy(F.desc(TIMESTAMP), F.asc("_kind"), *[F.desc(name) for name in sequence])
    seen = points.select(
        layout.by,
        "_signal",
        F.last("_point", ignorenulls=True).over(forward.rowsBetween(*running)).alias("_before"),
        F.last("_point", ignorenulls=True).over(backward.rowsBetween(*running)).alias("_after"),
        F.count("_point").over(keys).alias("_prices"),
    ).where(F.col("_signal").isNotNull())
    if layout.splits is not None:
        seen = _with_points_of_other_segments(seen, price_points, layout, sequence)

    at = F.unix_micros(F.col(f"_signal.{TIMESTAMP}"))
    before, after = F.col("_before"), F.col("_after")
    share = F.try_divide(at - before["at"], after["at"] - before["at"])
    value = (
        F.when(F.col("_prices") < 2, F.col("_signal.moving_avg_price"))
        .when(after["at"] == at, after["price"])
        .when(before.isNull() | after.isNull(), F.col("_signal.moving_avg_price"))
        .otherwise(before["price"] + (after["price"] - before["price"]) * share)
    )
    return seen.select("_signal.*", value.alias("signal_value"))


def _with_points_of_other_segments(
    seen: DataFrame, price_points: DataFrame, layout: Layout, sequence: Sequence[str]
) -> DataFrame:
    """Fill what a segment alone cannot know: its neighbours' nearest prices, and the key's number of prices."""
    place = F.struct(TIMESTAMP, *sequence)
    ends = price_points.groupBy(layout.by).agg(
        F.min_by("_point", place).alias("_first"),
        F.max_by("_point", place).alias("_last"),
        F.count("_point").alias("_n"),
    )
    every = layout.segments().join(ends, layout.by, "left")
    earlier = layout.across_segments().rowsBetween(Window.unboundedPreceding, -1)
    later = layout.across_segments(descending=True).rowsBetween(Window.unboundedPreceding, -1)
    outside = every.select(
        layout.by,
        F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(later).alias("_later"),
        F.sum("_n").over(Window.partitionBy(f"{layout.by}.key")).alias("_total"),
    )
    return seen.join(outside, layout.by, "left").withColumns(
        {
            "_before": F.coalesce("_before", "_earlier"),
            "_after": F.coalesce("_after", "_later"),
            "_prices": F.coalesce("_total", "_prices"),
        }
    )


def retain_recent(
    points: DataFrame,
    count: int = RECENT_POINTS,
    seconds: float = RECENT_SECONDS,
    sequence: Sequence[str] = FILE_SEQUENCE,
) -> DataFrame:
    """The newest ``count`` points of each ticker, less those more than ``seconds`` behind the newest.

    Spark applies the row limit before the shuffle as well, so a ticker sends at most ``count`` rows per map task.
    """
    newest_first = Window.partitionBy(TICKER).orderBy(F.desc(TIMESTAMP), *[F.desc(name) for name in sequence])
    kept = points.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= count)
    newest = F.max(TIMESTAMP).over(Window.partitionBy(TICKER))
    reach = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return (
        kept.withColumn("_newest", newest)
        .where(F.col(TIMESTAMP) >= F.col("_newest") - reach)
        .drop("_rank", "_newest")
    )
