"""Every operator as a query over the sample tables.

A query takes a session and the folder of the tables and returns a DataFrame. Doubles are rounded to six decimals and
timestamps carry no zone, so that the results can be compared with SQL on the same tables (``plans.oracles``).

Events are sparse, a few per hour and ticker in the smallest tables, so sliding windows are six hours long and move
by one hour. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.signals import consensus
from tickloom.operators import messages as msg
from tickloom.operators.clean import clean_quotes
from tickloom.operators.ordered import ROWS_PER_SEGMENT, Layout
from tickloom.operators.series import interpolate_signals, retain_recent
from tickloom.operators.windows import feature_snapshot, latest_quote, sliding_stats
from tickloom.plans import backtest as bt
from tickloom.plans import model as ml
from tickloom.plans.signals import gen_signal
from tickloom.schemas import CLEAN_TYPES, FEATURES, PRICE, TICKER, TIMESTAMP
from tickloom.session import QUERY_SETTINGS, apply_settings, fresh_folder, local_folder_if_unset, session_settings
from tickloom.sources import samples
from tickloom.sources.bars import daily_close, store_bars
from tickloom.sources.messages import check_messages, decode_messages, read_messages
from tickloom.sources.pages import extract_quotes
from tickloom.streaming import live, service
from tickloom.streaming.history import HistoryTable
from tickloom.streaming.monitor import ProgressLog, state_keys
from tickloom.streaming.once import publish_once, published
from tickloom.streaming.running import RunningView
from tickloom.streaming.sinks import fan_out, file_sink, quarantine, start_query
from tickloom.streaming.training import TrainingState

HOUR = 3600
WINDOW = 6 * HOUR
LONG_WINDOW = 240 * HOUR
AS_OF = "2024-01-25 00:00:00"
BARS_FROM, BARS_TO = "1993-01-01", "1998-01-01"
RECENT_SECONDS = 232_000
BAR_BUCKETS = 8
LATE_DAY = ("2024-01-02", "2024-01-03")
LIVE_REACH, CLOCK = 2 * HOUR, "~clock"
HISTORY_UNTIL = "2024-01-20"
ALL_MINUTES = 60 * 24 * 366 * 10  # longer than the events last
# The ``*_segmented`` queries cut a table into about this many segments, so that every scale has cut keys.
SEGMENTS = 40
# Averages of prices in cents often lie exactly between two six-decimal numbers, give or take the last bit, which
# depends on the order of summation. A billionth on top makes all of them go up, in Spark and in SQL.
DECIMALS, TIE_SHIFT = 6, 1e-9
# Daily returns are small numbers; slopes are quotients of sums, and differ with the order of summation.
RETURN_DECIMALS, SLOPE_DECIMALS = 12, 9
COLUMN_DECIMALS = {
    **dict.fromkeys(("returns", "lag_1", "lag_2", "strat_ols_1", "strat_ols_2"), RETURN_DECIMALS),
    **dict.fromkeys(("intercept_1", "intercept_2"), RETURN_DECIMALS),
    **dict.fromkeys(("b1_1", "b2_1", "b1_2", "b2_2"), SLOPE_DECIMALS),
}

Query = Callable[[SparkSession, str], DataFrame]


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _comparable(rows: DataFrame) -> DataFrame:
    columns = []
    for name, kind in rows.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column + TIE_SHIFT, COLUMN_DECIMALS.get(name, DECIMALS))
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(name))
    return rows.select(*columns)


# ---- messages and cleaning


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_quotes(samples.raw_quotes(spark, folder))


def _extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract_quotes(samples.quote_pages(spark, folder), keep=("event_id",))


def _cleaned(*fields: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return clean_quotes(samples.raw_quotes(spark, folder), fields)

    return query


def _read_back(messages: DataFrame, *passed: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Ticker and every field any encoder writes, or those of ``fields`` only, out of the JSON text."""
    schema = {
        **CLEAN_TYPES,
        "moving_avg_price": "double",
        "rsi": "double",
        "mac_signal": "int",
        "rsi_signal": "int",
        "prediction": "double",
        "ratio": "double",
        "ols_signal": "int",
        "timestamp": "string",
    }
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in schema.items() if fields is None or name in fields)
    return messages.select(
        *passed, F.get_json_object("key", "$.ticker_symbol").alias(TICKER), F.from_json("value", ddl).alias("value")
    ).select(*passed, TICKER, "value.*")


def _encode_quotes(spark, folder):
    return _read_back(msg.encode_quotes(_clean(spark, folder))).select(TICKER, *CLEAN_TYPES, TIMESTAMP)


def _encode_signals(spark, folder):
    encoded = msg.encode_signals(_signals(spark, folder))
    return _read_back(encoded).select(TICKER, TIMESTAMP, "moving_avg_price", "rsi", "mac_signal", "rsi_signal")


def _encode_ols(spark, folder):
    encoded = msg.encode_ols(_ols(spark, folder))
    return _read_back(encoded).select(TICKER, TIMESTAMP, PRICE, "prediction", "ratio", "ols_signal")


def _multiplexed(spark, folder):
    return msg.multiplex(msg.encode_quotes(_clean(spark, folder)), msg.encode_signals(_signals(spark, folder)))


def _multiplex(spark, folder):
    shown = (TICKER, TIMESTAMP, PRICE, "moving_avg_price", "rsi_signal", "mac_signal")
    return _read_back(_multiplexed(spark, folder), "topic").select("topic", *shown)


def _dispatch(spark, folder):
    shown = (TICKER, TIMESTAMP, PRICE, "moving_avg_price", "rsi_signal", "mac_signal")
    return _read_back(msg.dispatch(_multiplexed(spark, folder)), "kind").select("kind", *shown)


# ---- windows and signals


def _stats(use_panes: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return sliding_stats(samples.prices(spark, folder), WINDOW, HOUR, use_panes=use_panes)

    return query


def _long_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten days, by the hour."""
    return sliding_stats(samples.prices(spark, folder), LONG_WINDOW, HOUR)


def _signals(spark, folder, spread: bool = False):
    """All windows of the quotes."""
    return gen_signal(samples.prices(spark, folder, spread), WINDOW, HOUR)


def _ended_signals(spark, folder):
    """The windows that have ended at a given time."""
    return gen_signal(samples.prices(spark, folder), WINDOW, HOUR, as_of=_as_of())


def _signal_columns(*names: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _signals(spark, folder).select(TICKER, TIMESTAMP, *names)

    return query


def _consensus(spark, folder):
    both = consensus(F.col("rsi_signal"), F.col("mac_signal")).alias("consensus")
    return _signals(spark, folder).select(TICKER, TIMESTAMP, "rsi_signal", "mac_signal", both)


def _segment_rows(spark: SparkSession, folder: str, table: str, segmented: bool) -> int:
    return max(1, samples.table(spark, folder, table).count() // SEGMENTS) if segmented else ROWS_PER_SEGMENT


def _interpolate(segmented: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        signals = _signals(spark, folder)
        rows_per_segment = _segment_rows(spark, folder, "events", segmented)
        valued = interpolate_signals(samples.prices(spark, folder), signals, rows_per_segment=rows_per_segment)
        return valued.select(TICKER, TIMESTAMP, "moving_avg_price", "signal_value")

    return query


def _retain_signals(spark, folder):
    return retain_recent(_signals(spark, folder), sequence=(), seconds=RECENT_SECONDS).select(TICKER, TIMESTAMP, PRICE, "moving_avg_price")


def _page_quotes(spark, folder):
    """The extraction over pages as they come, none of which need be a quote page."""
    pages = samples.table(spark, folder, "pages").select(F.lit("A").alias(TICKER), "page_id", "html")
    return extract_quotes(pages, keep=("page_id",))


def _retain(spark, folder):
    return retain_recent(samples.prices(spark, folder), seconds=RECENT_SECONDS)


# ---- model


def _training_set(horizon: int, segmented: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows_per_segment = _segment_rows(spark, folder, "events", segmented)
        labelled = ml.training_set(_clean(spark, folder), horizon, rows_per_segment=rows_per_segment)
        return labelled.select(TICKER, TIMESTAMP, "event_id", PRICE, "label")

    return query


def _model(spark, folder):
    return ml.train_elastic_net(ml.training_set(_clean(spark, folder)))


def _training_moments(spark, folder):
    moments = ml.training_moments(ml.training_set(_clean(spark, folder)))
    scaled = (F.col("mean") / F.col("deviation")).alias("scaled_mean")
    return moments.select("feature", "other", scaled, "correlation")


def _optimality(spark, folder):
    training = ml.training_set(_clean(spark, folder))
    return ml.optimality(training, ml.train_elastic_net(training, max_iter=2000, tol=1e-13))


def _scores(spark, folder):
    return ml.score(_clean(spark, folder), _model(spark, folder))


def _ols(spark, folder):
    return ml.ols_signal(_scores(spark, folder), _as_of())


# ---- backtest


def _bars(spark, folder):
    return samples.daily_bars(spark, folder)


def _features(spark, folder):
    bars, layout = bt.lay_out(_bars(spark, folder))
    return bt.prepared(bars, layout), layout


def _backtest_step(step: Callable[[DataFrame, Layout], DataFrame], *shown: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars, layout = bt.lay_out(_bars(spark, folder))
        return step(bars, layout).select(TICKER, "date", *shown)

    return query


def _held(bars: DataFrame, layout: Layout) -> DataFrame:
    features = bt.prepared(bars, layout)
    return bt.positions(features, bt.grouped_ols(features), layout)


def _changed(bars: DataFrame, layout: Layout) -> DataFrame:
    return bt.position_changes(bt.strategy_returns(_held(bars, layout)), layout)


def _grown(bars: DataFrame, layout: Layout) -> DataFrame:
    return bt.cumulative_returns(bt.strategy_returns(_held(bars, layout)), layout)


def _coefficients(spark, folder):
    features, _ = _features(spark, folder)
    return bt.grouped_ols(features)


def _backtest(segmented: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return bt.backtest(_bars(spark, folder), rows_per_segment=_segment_rows(spark, folder, "orders", segmented))

    return query


def _markers(spark, folder):
    return bt.trade_markers(bt.backtest(_bars(spark, folder)))


# ---- streams: messages are laid down in steps, and the named query resumes after each


def _state(spark: SparkSession) -> dict[str, str]:
    return service.stateful_settings(spark.sparkContext.defaultParallelism)


class _Staged:
    """A folder of message files that grows step by step, and the clean-quote stream that reads it."""

    def __init__(self, spark: SparkSession, folder: str, purpose: str):
        self.spark = spark
        self.root = fresh_folder(spark, purpose)
        self.source = samples.quote_messages(spark, folder)
        self.folder = folder

    def steps(self, n: int) -> list[DataFrame]:
        spans = samples.event_span(self.spark, self.folder, n)
        return [self.source.where((F.col(TIMESTAMP) >= a) & (F.col(TIMESTAMP) < b)) for a, b in spans]

    def lay_down(self, messages: DataFrame) -> None:
        messages.write.mode("append").parquet(f"{self.root}/messages")

    def quotes(self) -> DataFrame:
        return clean_quotes(decode_messages(read_messages(self.spark, "parquet", path=f"{self.root}/messages")))

    def run(self, rows: DataFrame, name: str, target) -> None:
        """Process all there is, then stop; fails as the query fails."""
        start_query(rows, name, target, f"{self.root}/checkpoints").awaitTermination()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def sink(self, name: str, topic: str | None = None):
        return file_sink(name, f"{self.root}/{name}", topic=topic)


def _stream_clean(steps: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        staged = _Staged(spark, folder, "clean")
        for messages in staged.steps(steps):
            staged.lay_down(messages)
            staged.run(staged.quotes(), "clean-quotes", staged.sink("clean"))
        return staged.table("clean").select(TICKER, TIMESTAMP, "event_id", *CLEAN_TYPES)

    return query


def _stream_signals(
    spark: SparkSession, folder: str, chunks: Callable[[_Staged], list[DataFrame]], use_panes: bool = False
) -> DataFrame:
    staged = _Staged(spark, folder, "signals")
    with session_settings(spark, _state(spark)):
        for messages in chunks(staged):
            staged.lay_down(messages)
            signals = gen_signal(
                staged.quotes(), WINDOW, HOUR, watermark=service.WATERMARK, use_panes=use_panes
            )
            staged.run(signals, "rsi-mac-signal", staged.sink("signals"))
    return staged.table("signals")


def _stream_gen_signal(use_panes: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _stream_signals(spark, folder, lambda staged: staged.steps(3), use_panes)

    return query


def _stream_late_data(spark, folder):
    """One day is held back until all later ones are processed; its quotes must not reopen closed windows."""
    late = (F.col(TIMESTAMP) >= LATE_DAY[0]) & (F.col(TIMESTAMP) < LATE_DAY[1])

    def chunks(staged: _Staged) -> list[DataFrame]:
        on_time = [messages.where(~late) for messages in staged.steps(2)]
        return [*on_time, staged.source.where(late)]

    return _stream_signals(spark, folder, chunks)


def _stream_fanout(spark, folder):
    staged = _Staged(spark, folder, "fanout")
    staged.lay_down(staged.source)
    sinks = [staged.sink("topic", topic=msg.CLEAN_TOPIC), staged.sink("collection")]
    staged.run(staged.quotes(), "clean-quotes", fan_out(sinks))
    sent = _read_back(staged.table("topic")).withColumn("sink", F.lit("topic"))
    stored = staged.table("collection").withColumn("sink", F.lit("collection"))
    both = [rows.select("sink", TICKER, PRICE, "average_volume") for rows in (sent, stored)]
    return (
        both[0]
        .unionByName(both[1])
        .groupBy("sink", TICKER)
        .agg(F.count("*").alias("n"), F.sum(PRICE).alias("price_sum"), F.sum("average_volume").alias("volume_sum"))
    )


def _stream_ols(spark, folder):
    staged = _Staged(spark, folder, "ols")
    store = ml.ModelStore(spark, f"{staged.root}/models")
    sinks = [staged.sink("topic", topic=msg.OLS_TOPIC), staged.sink("collection")]
    for messages in staged.steps(2):
        staged.lay_down(messages)
        staged.run(staged.quotes(), "training", service.train_on_batch(store))
        staged.run(staged.quotes(), "ols-signal", service.score_batch(store, sinks))
    return staged.table("collection").select("batch_id", TICKER, PRICE, "prediction", "ratio", "ols_signal")


def _stream_training_set(horizon: int) -> Query:
    """Labels that reach into earlier batches, and one batch that is taken twice."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        staged = _Staged(spark, folder, "training-set")
        state = TrainingState(spark, f"{staged.root}/state", horizon=horizon)
        sink = staged.sink("training")

        def take(rows: DataFrame, batch_id: int) -> None:
            rows.persist()
            for _ in range(2 if batch_id == 1 else 1):
                sink.write_batch(state.training_rows(rows, batch_id), batch_id)
            rows.unpersist()

        for messages in staged.steps(4):
            staged.lay_down(messages)
            staged.run(staged.quotes(), "training", take)
        return staged.table("training").select(TICKER, TIMESTAMP, "event_id", PRICE, "label")

    return query


def _stream_model(spark, folder):
    """The model of each batch, from kept moments: all quotes so far."""
    staged = _Staged(spark, folder, "model")
    state = TrainingState(spark, f"{staged.root}/state", minutes=ALL_MINUTES)

    def take(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        model = state.model(rows, batch_id)
        ml.coefficient_table(spark, model).write.parquet(f"{staged.root}/models/batch_id={batch_id}")
        rows.unpersist()

    for messages in staged.steps(2):
        staged.lay_down(messages)
        staged.run(staged.quotes(), "training", take)
    return staged.table("models").select(F.col("batch_id").cast("int").alias("batch_id"), "feature", "coefficient")


def _stream_multiplex(spark, folder):
    """Quotes and signals merged live: the signals are silent at first, and some quotes come twice."""
    staged = _Staged(spark, folder, "multiplex")
    kept = (TIMESTAMP, "event_id")
    signals = _signals(spark, folder, spread=True).withColumn("event_id", F.xxhash64(TICKER, TIMESTAMP))
    signals = msg.encode(signals, msg.SIGNAL_MESSAGE, kept)
    quotes = [msg.encode(clean_quotes(decode_messages(part)), msg.QUOTE_MESSAGE, kept) for part in staged.steps(2)]
    sinks = {kind: [staged.sink(kind)] for kind in ("quote", "signal")}
    with session_settings(spark, {**_state(spark), **live.merge_settings(live.WAIT)}):
        for step, new_signals in enumerate((signals.limit(0), signals)):
            new_quotes = quotes[step]
            if step:  # what comes twice lies there from the first step
                new_quotes = new_quotes.union(staged.table("quotes").select(*new_quotes.columns).where("event_id % 3 = 0"))
            new_quotes.write.mode("append").parquet(f"{staged.root}/quotes")
            new_signals.write.mode("append").parquet(f"{staged.root}/signals")
            inputs = [read_messages(spark, "parquet", path=f"{staged.root}/{name}") for name in ("quotes", "signals")]
            staged.run(live.live_merge(*inputs), "live", live.dispatch_to(sinks))
    shown = (TICKER, TIMESTAMP, PRICE, "moving_avg_price", "rsi_signal", "mac_signal")
    both = [staged.table(kind).select("key", "value").withColumn("kind", F.lit(kind)) for kind in sinks]
    return _read_back(both[0].unionByName(both[1]), "kind", fields=shown).select("kind", *shown)


def _stream_view(keep: Callable[[DataFrame], DataFrame], *names: str) -> Query:
    """A view that follows the quotes, as the last of four batches has left it."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        staged = _Staged(spark, folder, "view")
        quotes = staged.quotes if not names else lambda: staged.quotes().select(*names)
        view = None

        def take(rows: DataFrame, batch_id: int) -> None:
            nonlocal view
            view = view or RunningView(spark, f"{staged.root}/view", rows.schema, keep)
            view.take(rows, batch_id).write.mode("overwrite").parquet(f"{staged.root}/shown")

        for messages in staged.steps(4):
            staged.lay_down(messages)
            staged.run(quotes(), "view", take)
        return staged.table("shown")

    return query


def _stream_interpolate(spark, folder):
    """Signals and prices as two streams. Last comes a price and a signal of another ticker, by which all others are closed."""
    staged = _Staged(spark, folder, "interpolate")
    prices, signals = samples.prices(spark, folder), _signals(spark, folder).select(TICKER, TIMESTAMP, "moving_avg_price")
    signals.write.parquet(f"{staged.root}/all-signals")  # read for each part
    signals = spark.read.schema(signals.schema).parquet(f"{staged.root}/all-signals")
    later = (F.max(TIMESTAMP) + F.expr("interval 10 days")).alias(TIMESTAMP)
    closing = prices.groupBy(F.lit(CLOCK).alias(TICKER)).agg(later, F.lit(0).cast("long").alias("event_id"), F.lit(1.0).alias(PRICE))
    clock = closing.select(TICKER, TIMESTAMP, F.lit(1.0).alias("moving_avg_price"))
    spans = samples.event_span(spark, folder, 3)
    parts = [[rows.where((F.col(TIMESTAMP) >= a) & ((F.col(TIMESTAMP) < b) | F.lit(at == 2))) for rows in (prices, signals)] for at, (a, b) in enumerate(spans)]
    with session_settings(spark, _state(spark)):
        for some_prices, some_signals in (*parts, (closing, clock)):
            inputs = []
            for name, rows in (("prices", some_prices), ("signals", some_signals)):
                rows.repartition(*rows.columns).write.mode("append").parquet(f"{staged.root}/{name}")
                inputs.append(spark.readStream.schema(rows.schema).parquet(f"{staged.root}/{name}"))
            staged.run(live.interpolate_live(*inputs, reach_seconds=LIVE_REACH), "interpolate", staged.sink("valued"))
    return staged.table("valued").select(TICKER, TIMESTAMP, "moving_avg_price", "signal_value").where(F.col(TICKER) != CLOCK)


def _backtest_stored(spark, folder):
    """The backtest over bars that are stored by ticker."""
    place = fresh_folder(spark, "bars")
    name = place.rpartition("/")[2].replace("-", "_")
    return bt.backtest(store_bars(_bars(spark, folder), name, place, BAR_BUCKETS))


def _stream_open_windows(spark, folder):
    """What a windowed query holds after its last restart: the windows that its watermark has not passed."""
    staged = _Staged(spark, folder, "open-windows")
    with session_settings(spark, _state(spark)):
        for messages in staged.steps(2):
            staged.lay_down(messages)
            signals = gen_signal(staged.quotes(), WINDOW, HOUR, watermark=service.WATERMARK, use_panes=False)
            staged.run(signals, "signals", staged.sink("signals"))
    keys = state_keys(spark, f"{staged.root}/checkpoints/signals")
    return keys.groupBy(F.col(f"key.{TICKER}").alias(TICKER)).agg(
        F.count(F.lit(1)).alias("open_windows"), F.min("key.window.end").alias("first_end")
    )


def _stream_late_rows(spark, folder):
    """What the running query reports of quotes that came too late: each ticker and window of theirs."""
    late = (F.col(TIMESTAMP) >= LATE_DAY[0]) & (F.col(TIMESTAMP) < LATE_DAY[1])
    staged, log = _Staged(spark, folder, "late-rows"), ProgressLog()
    spark.streams.addListener(log)
    try:
        with session_settings(spark, _state(spark)):
            for messages in (*[part.where(~late) for part in staged.steps(2)], staged.source.where(late)):
                staged.lay_down(messages)
                signals = gen_signal(staged.quotes(), WINDOW, HOUR, watermark=service.WATERMARK, use_panes=False)
                query = start_query(signals, "late-rows", staged.sink("signals"), f"{staged.root}/checkpoints")
                query.awaitTermination()
                log.wait_for(query)
    finally:
        spark.streams.removeListener(log)
    return log.table(spark).where("query_name = 'late-rows'").groupBy("query_name").agg(F.sum("late_rows").alias("late_rows"))


def _stream_history(spark, folder):
    """Clean quotes stored by day, a few hours a batch, and read back by day."""
    staged = _Staged(spark, folder, "history")
    table = HistoryTable(spark, f"{staged.root}/history", compact_after=3)

    def take(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        for _ in range(2):
            table.write_batch(rows, batch_id)
        rows.unpersist()

    for messages in staged.steps(6):
        staged.lay_down(messages)
        staged.run(staged.quotes(), "history", take)
    return table.days("2000-01-01", HISTORY_UNTIL).select(TICKER, TIMESTAMP, "event_id", *CLEAN_TYPES)


def _stream_once(spark, folder):
    """Clean quotes published batch by batch, each as a whole and once."""
    staged = _Staged(spark, folder, "once")
    for messages in staged.steps(3):
        staged.lay_down(messages)
        quotes = staged.quotes().select(TICKER, TIMESTAMP, "event_id", *CLEAN_TYPES)
        publish_once(quotes, "once", f"{staged.root}/once", f"{staged.root}/checkpoints").awaitTermination()
    return published(spark, f"{staged.root}/once", quotes.schema)


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The messages, some of them cut short, of another shape, without a ticker or without a value."""
    event = F.col("event_id")
    value = (
        F.when(event % 23 == 0, F.lit(None))
        .when(event % 11 == 0, F.expr("left(value, length(value) - 5)"))
        .when(event % 7 == 0, F.concat(F.lit("["), F.col("value"), F.lit("]")))
        .otherwise(F.col("value"))
    )
    key = F.when(event % 13 == 0, F.lit("{}")).otherwise(F.col("key"))
    return samples.quote_messages(spark, folder).withColumns({"value": value, "key": key})


def _stream_quarantine(spark, folder):
    """Messages that cannot be read, by reason, and those that can: together as many as came."""
    staged = _Staged(spark, folder, "quarantine")
    staged.lay_down(_damaged(spark, folder))
    good = fan_out([staged.sink("good")])
    checked = check_messages(read_messages(spark, "parquet", path=f"{staged.root}/messages"))
    target = quarantine(lambda rows, batch_id: good(clean_quotes(decode_messages(rows)), batch_id), [staged.sink("bad")])
    staged.run(checked, "quarantine", target)
    good_rows = staged.table("good").select("event_id", F.lit(None).cast("string").alias("problem"), PRICE)
    return good_rows.unionByName(staged.table("bad").select("event_id", "problem", F.lit(None).cast("double").alias(PRICE)))


QUERIES: dict[str, Query] = {
    "decode_messages": lambda spark, folder: decode_messages(samples.quote_messages(spark, folder)),
    "extract_quote_fields": _extract,
    "daily_close": lambda spark, folder: daily_close(_bars(spark, folder), BARS_FROM, BARS_TO),
    "clean_prices": _cleaned(
        "regular_market_price",
        "regular_market_change",
        "regular_market_change_percent",
        "regular_market_previous_close",
        "regular_market_open",
    ),
    "clean_bid_ask": _cleaned("bid_price", "bid_size", "ask_price", "ask_size"),
    "clean_volumes": _cleaned("regular_market_volume", "average_volume"),
    "clean_market_cap": _cleaned("market_cap", "market_cap_type"),
    "clean_ratios": _cleaned("beta", "pe_ratio", "eps", "1y_target_est"),
    "clean_quotes": _clean,
    "encode_quotes": _encode_quotes,
    "encode_signals": _encode_signals,
    "encode_ols": _encode_ols,
    "multiplex_messages": _multiplex,
    "dispatch_messages": _dispatch,
    "sliding_stats": _stats(use_panes=False),
    "sliding_stats_panes": _stats(use_panes=True),
    "sliding_stats_long": _long_stats,
    "mac_signal": _signal_columns(PRICE, "moving_avg_price", "mac_signal"),
    "rsi": _signal_columns("rsi"),
    "rsi_signal": _signal_columns("rsi", "rsi_signal"),
    "gen_signal": _ended_signals,
    "consensus_signal": _consensus,
    "interpolate_signal": _interpolate(segmented=False),
    "interpolate_signal_segmented": _interpolate(segmented=True),
    "retain_recent": _retain,
    "retain_recent_signals": _retain_signals,
    "extract_from_pages": _page_quotes,
    "latest_quote": lambda spark, folder: latest_quote(_clean(spark, folder)),
    "feature_snapshot": lambda spark, folder: feature_snapshot(_clean(spark, folder)).select(TICKER, *FEATURES),
    "training_set": _training_set(ml.LABEL_HORIZON),
    "training_set_lead": _training_set(-ml.LABEL_HORIZON),
    "training_set_segmented": _training_set(ml.LABEL_HORIZON, segmented=True),
    "training_set_lead_segmented": _training_set(-ml.LABEL_HORIZON, segmented=True),
    "train_elastic_net": lambda spark, folder: ml.coefficient_table(spark, _model(spark, folder)),
    "training_moments": _training_moments,
    "elastic_net_optimality": _optimality,
    "score_elastic_net": _scores,
    "ols_signal": _ols,
    "log_returns": _backtest_step(bt.log_returns, "close", "returns"),
    "direction": _backtest_step(
        lambda bars, layout: bt.direction(bt.log_returns(bars, layout)), "returns", "direction"
    ),
    "lag_features": _backtest_step(bt.prepared, "returns", "lag_1", "lag_2"),
    "grouped_ols": _coefficients,
    "positions": _backtest_step(_held, "pos_ols_1", "pos_ols_2"),
    "strategy_returns": _backtest_step(
        lambda bars, layout: bt.strategy_returns(_held(bars, layout)), "strat_ols_1", "strat_ols_2"
    ),
    "position_changes": _backtest_step(_changed, "positions_ols_1", "positions_ols_2"),
    "cumulative_returns": _backtest_step(_grown, "cum_returns", "cum_strat_ols_1", "cum_strat_ols_2"),
    "trade_markers": _markers,
    "backtest": _backtest(segmented=False),
    "backtest_segmented": _backtest(segmented=True),
    "backtest_stored": _backtest_stored,
    "stream_clean_quotes": _stream_clean(steps=1),
    "stream_restart": _stream_clean(steps=3),
    "stream_gen_signal": _stream_gen_signal(use_panes=False),
    "stream_gen_signal_panes": _stream_gen_signal(use_panes=True),
    "stream_late_data": _stream_late_data,
    "stream_fanout": _stream_fanout,
    "stream_ols_signal": _stream_ols,
    "stream_multiplex": _stream_multiplex,
    "stream_latest_quote": _stream_view(latest_quote),
    "stream_retain_recent": _stream_view(
        lambda rows: retain_recent(rows, seconds=RECENT_SECONDS), TICKER, TIMESTAMP, "event_id", PRICE
    ),
    "stream_interpolate": _stream_interpolate,
    "stream_open_windows": _stream_open_windows,
    "stream_late_rows": _stream_late_rows,
    "stream_history": _stream_history,
    "stream_once": _stream_once,
    "stream_quarantine": _stream_quarantine,
    "stream_training_set": _stream_training_set(ml.LABEL_HORIZON),
    "stream_training_set_lead": _stream_training_set(-ml.LABEL_HORIZON),
    "stream_elastic_net": _stream_model,
}


def comparable_queries() -> dict[str, Query]:
    def wrap(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            local_folder_if_unset(spark)
            apply_settings(spark, QUERY_SETTINGS)
            return _comparable(query(spark, folder))

        return run

    return {name: wrap(query) for name, query in QUERIES.items()}
