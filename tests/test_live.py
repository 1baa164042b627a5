"""The live merge, the stored history, the progress log and the quarantine."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators.series import retain_recent
from tickloom.operators.windows import latest_quote
from tickloom.schemas import CLEAN_TOPIC, SIGNAL_TOPIC
from tickloom.session import fresh_folder, session_settings
from tickloom.sources.messages import check_messages, read_messages
from tickloom.streaming import live, service
from tickloom.streaming.history import HistoryTable
from tickloom.streaming.monitor import ProgressLog, audit_state, state_keys
from tickloom.streaming.running import RunningView
from tickloom.streaming.sinks import file_sink, start_query

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
MESSAGES = "key STRING, value STRING, micros BIGINT, event_id BIGINT"


@pytest.fixture
def folder(spark):
    return fresh_folder(spark, "test")


def lay_down(spark, path, rows):
    base = int(START.timestamp() * 1_000_000)
    rows = [(f'{{"ticker_symbol":"{ticker}"}}', value, base + second * 1_000_000, number) for ticker, second, value, number in rows]
    frame = spark.createDataFrame(rows, MESSAGES).withColumn("timestamp", F.timestamp_micros("micros")).drop("micros")
    frame.select("key", "value", "timestamp", "event_id").coalesce(1).write.mode("append").parquet(path)


def quote(ticker, second, number):
    return ticker, second, '{"regular_market_price":1.5}', number


def signal(ticker, second, number):
    return ticker, second, '{"rsi_signal":1}', number


def merged(spark, folder, steps, rule):
    sinks = {kind: [file_sink(kind, f"{folder}/{kind}")] for kind in ("quote", "signal")}
    with session_settings(spark, {**service.stateful_settings(2), **live.merge_settings(rule)}):
        for quotes, signals in steps:
            lay_down(spark, f"{folder}/quotes", quotes)
            lay_down(spark, f"{folder}/signals", signals)
            inputs = [read_messages(spark, "parquet", path=f"{folder}/{name}") for name in ("quotes", "signals")]
            query = start_query(live.live_merge(*inputs, delay="10 seconds"), "live", live.dispatch_to(sinks), f"{folder}/checkpoints")
            query.awaitTermination()
    state = query.recentProgress[-1].stateOperators[0].numRowsTotal
    return {kind: spark.read.parquet(f"{folder}/{kind}") for kind in sinks}, state


def test_merge_passes_each_message_once_while_an_input_is_silent(spark, folder):
    steps = [([quote("A", at, at) for at in range(50)], []), ([quote("A", 100, 100), quote("A", 3, 3)], [signal("A", 5, 5)]), ([], [signal("B", 6, 6)])]
    found, state = merged(spark, folder, steps, live.WAIT)
    assert sorted(row.event_id for row in found["quote"].collect()) == [*range(50), 100]
    assert sorted(row.event_id for row in found["signal"].collect()) == [5, 6]
    assert {row.topic for row in found["quote"].union(found["signal"]).collect()} == {CLEAN_TOPIC, SIGNAL_TOPIC}


def test_time_can_go_on_without_a_silent_input(spark, folder):
    steps = [([quote("A", at, at) for at in range(50)], []), ([quote("A", 1000, 1000)], []), ([quote("A", 1001, 1001), quote("A", 2000, 2000)], [signal("A", 5, 5)])]
    found, state = merged(spark, folder, steps, live.GO_ON)
    assert found["quote"].count() == 53 and found["signal"].count() == 0  # the signal is behind the watermark by then
    assert state < 10  # quotes of the first step are forgotten
    with pytest.raises(ValueError):
        live.merge_settings("sometimes")


def test_live_interpolation_keeps_little(spark, folder):
    """Signals come out when both streams have passed them, and what they need no more is forgotten."""
    schemas = {
        "prices": "ticker_symbol STRING, timestamp TIMESTAMP, event_id LONG, regular_market_price DOUBLE",
        "signals": "ticker_symbol STRING, timestamp TIMESTAMP, moving_avg_price DOUBLE",
    }
    with session_settings(spark, service.stateful_settings(2)):
        for step in range(4):
            at = [START + timedelta(seconds=1000 * step + second) for second in range(0, 1000, 10)]
            rows = {
                "prices": [("A", when, 100 * step + number, float(when.timestamp() % 1000)) for number, when in enumerate(at)],
                "signals": [("A", when + timedelta(seconds=5), -1.0) for when in at[::5]],
            }
            inputs = []
            for name, schema in schemas.items():
                spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
                inputs.append(spark.readStream.schema(schema).parquet(f"{folder}/{name}"))
            query = start_query(live.interpolate_live(*inputs, reach_seconds=60), "valued", file_sink("valued", f"{folder}/valued"), f"{folder}/checkpoints")
            query.awaitTermination()
            state = [sum(part.numRowsTotal for part in progress.stateOperators) for progress in query.recentProgress]
            assert state[-1] < 60
    found = spark.read.parquet(f"{folder}/valued").collect()
    newest = START + timedelta(seconds=3990)
    assert len({row.timestamp for row in found}) == len(found) >= 78
    # Between two prices ten seconds apart lies half their sum, but for where the price falls back to 0.
    fits = [abs(row.signal_value - (row.timestamp.timestamp() % 1000)) < 1e-6 or row.timestamp.timestamp() % 1000 > 990 for row in found]
    assert all(fits) and max(row.timestamp.replace(tzinfo=timezone.utc) for row in found) < newest


def test_views_follow_all_rows_and_forget_idle_tickers(spark, folder):
    schema = "ticker_symbol STRING, timestamp TIMESTAMP, event_id LONG, regular_market_price DOUBLE"
    steps = [[("A", 0), ("A", 5), ("B", 1), (None, 2)], [("A", 3), ("B", 9)], [], [("A", 700), ("B", 690), ("A", 650)], [(None, 705), ("A", 500)]]

    def keep(rows):
        return retain_recent(rows, count=3, seconds=100)

    frames, number = [], 0
    for step in steps:
        rows = [(ticker, START + timedelta(seconds=second), number + at, float(second)) for at, (ticker, second) in enumerate(step)]
        number += len(step)
        frames.append(spark.createDataFrame(rows, schema))
    whole = RunningView(spark, f"{folder}/whole", frames[0].schema, keep)
    newest = RunningView(spark, f"{folder}/newest", frames[0].schema, latest_quote)
    idle = RunningView(spark, f"{folder}/idle", frames[0].schema, keep, idle_minutes=5)
    sofar = spark.createDataFrame([], schema)
    for at, rows in enumerate(frames):
        sofar = sofar.union(rows)
        for _ in range(2):
            assert sorted(map(str, whole.take(rows, at).collect())) == sorted(map(str, keep(sofar).collect()))
            assert sorted(map(str, newest.take(rows, at).collect())) == sorted(map(str, latest_quote(sofar).select(*sofar.columns).collect()))
            shown = {row.ticker_symbol for row in idle.take(rows, at).collect()}
        assert shown == ({"A", "B", None} if at != 3 else {"A", "B"})


def rows_of(spark, first, number, hours=0):
    start = int((START + timedelta(hours=hours)).timestamp())
    return spark.range(first, first + number).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(start) + F.col("id") % 60).alias("timestamp"))


def test_history_lists_days_and_not_batches(spark, folder):
    table = HistoryTable(spark, folder, compact_after=4)
    assert table.days("2024-01-01", "2024-12-31") is None
    for at in range(25):
        table.write_batch(rows_of(spark, 10 * at, 10, hours=24 * (at // 12)), at)
        assert table.days("2024-01-01", "2024-12-31").count() == 10 * (at + 1)
    table.write_batch(rows_of(spark, 240, 10, hours=48), 24)  # repeated
    assert sorted(row.event_id for row in table.days("2024-01-01", "2024-12-31").collect()) == [*range(250)]
    assert table.days("2024-03-02", "2024-03-02").count() == 120 and table.days("2024-03-09", "2024-03-09") is None
    assert len(table.parts("2024-03-01", "2024-03-01")) <= 4 and len(table.parts("2024-01-01", "2024-12-31")) <= 12
    listed = spark.read.parquet(f"{folder}/manifest").select("version").distinct().count()
    assert listed <= 4


def test_a_reader_keeps_what_it_has_begun_to_read(spark, folder):
    table = HistoryTable(spark, folder, compact_after=2)
    for at in range(3):
        table.write_batch(rows_of(spark, 10 * at, 10), at)
    begun = table.days("2024-03-01", "2024-03-01")
    table.write_batch(rows_of(spark, 30, 10), 3)
    assert begun.count() == 30 and table.days("2024-03-01", "2024-03-01").count() == 40


def test_training_reads_the_days_it_needs(spark, folder):
    table = HistoryTable(spark, folder)
    for at in range(5):
        table.write_batch(rows_of(spark, 10 * at, 10, hours=24 * at), at)
    batch = rows_of(spark, 100, 5, hours=96)
    recent = service.recent_history(batch, table, minutes=60 * 30)
    assert sorted(row.event_id for row in recent.collect()) == [*range(30, 45)]  # up to the batch's newest
    files = {name.split("/date=")[1][:10] for name in recent.inputFiles()}
    assert files == {"2024-03-03", "2024-03-04", "2024-03-05"}  # the span begins on the first of them
    assert service.recent_history(batch.limit(0), table, 10).count() == 0


def test_log_counts_late_rows_and_state(spark, folder):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        with session_settings(spark, service.stateful_settings(2)):
            for seconds in (range(0, 100, 10), [500], [5, 6, 7, 600]):
                lay_down(spark, f"{folder}/quotes", [quote("A", second, second) for second in seconds])
                rows = read_messages(spark, "parquet", path=f"{folder}/quotes").withWatermark("timestamp", "1 second")
                windows = rows.groupBy(F.window("timestamp", "10 seconds")).count()
                query = start_query(windows, "counted", file_sink("counts", f"{folder}/counts"), f"{folder}/checkpoints")
                query.awaitTermination()
                log.wait_for(query)
    finally:
        spark.streams.removeListener(log)
    totals = log.totals()["counted"]
    assert totals.input_rows == 15 and totals.late_rows == 1 and totals.state_rows == 1 and totals.batches >= 3
    assert log.table(spark).where("query_name = 'counted'").count() == totals.batches
    with pytest.raises(TimeoutError):
        log.wait_for(type("Query", (), {"runId": "none", "name": "none"}), 0.1)


def test_problems_of_messages(spark):
    key = '{"ticker_symbol":"A"}'
    rows = [(key, '{"bid":"1"}'), (key, "{}"), (key, None), (key, ""), (key, '{"bid":'), (key, "[1]"), (key, '"text"'), (key, "null"), ("{}", "{}"), (None, "{}"), ("x", "{}")]
    found = check_messages(spark.createDataFrame(rows, "key STRING, value STRING")).select("problem").collect()
    assert [row.problem for row in found] == [
        None, None, "no value", "not JSON", "not JSON", "not an object", "not an object", "not an object", "no ticker", "no ticker", "no ticker",
    ]


def test_state_of_a_stopped_query(spark, folder):
    with session_settings(spark, service.stateful_settings(3)):
        lay_down(spark, f"{folder}/quotes", [quote(ticker, second, second) for second in (0, 500, 505, 520) for ticker in "AB"])
        rows = read_messages(spark, "parquet", path=f"{folder}/quotes").withWatermark("timestamp", "10 seconds")
        windows = rows.groupBy("key", F.window("timestamp", "10 seconds")).count()
        start_query(windows, "counted", file_sink("counts", f"{folder}/counts"), f"{folder}/checkpoints").awaitTermination()
    (row,) = audit_state(spark, f"{folder}/checkpoints/counted").collect()
    assert (row.operator, row.partitions, row.keys) == ("stateStoreSave", 3, 2) and 1 <= row.most_keys <= 2 and row.empty in (1, 2)
    assert state_keys(spark, f"{folder}/checkpoints/counted").select("key.window.start").distinct().count() == 1
