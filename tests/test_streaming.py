from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators.clean import clean_quotes
from tickloom.plans import model as ml
from tickloom.plans.signals import gen_signal
from tickloom.schemas import CLEAN_TOPIC, FEATURES, SIGNAL_TOPIC
from tickloom.session import fresh_folder, session_settings, shared_folder
from tickloom.sources import samples
from tickloom.sources.messages import decode_messages, read_messages
from tickloom.streaming import service
from tickloom.streaming.sinks import Sink, collection_sink, console_sink, fan_out, file_sink, start_query, topic_sink

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MESSAGES = "key STRING, value STRING, micros BIGINT, event_id BIGINT"


def message_rows(seconds, first_id=0, ticker="A", price=lambda second: 100.0 + second % 7):
    base = int(START.timestamp() * 1_000_000)
    return [
        (f'{{"ticker_symbol": "{ticker}"}}', f'{{"regular_market_price": "{price(s):,.2f}"}}', base + s * 1_000_000, first_id + i)
        for i, s in enumerate(seconds)
    ]


def lay_down(spark, rows, folder):
    frame = spark.createDataFrame(rows, MESSAGES)
    frame = frame.select("key", "value", F.timestamp_micros("micros").alias("timestamp"), "event_id")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/messages")


def quotes_of(spark, folder):
    return clean_quotes(decode_messages(read_messages(spark, "parquet", path=f"{folder}/messages")))


def run(rows, name, target, folder):
    query = start_query(rows, name, target, f"{folder}/checkpoints")
    query.awaitTermination()
    return query


@pytest.fixture
def folder(spark):
    return fresh_folder(spark, "test")


def test_default_windows_close_behind_the_watermark(spark, folder):
    """Windows of 300 s every 10 s, quotes in three steps; the stream emits what the batch has, once closed."""
    seconds = list(range(0, 900, 3))
    with session_settings(spark, service.stateful_settings(4)):
        for part in (seconds[:100], seconds[100:200], seconds[200:]):
            lay_down(spark, message_rows(part, part[0]), folder)
            signals = gen_signal(quotes_of(spark, folder), watermark=service.WATERMARK)
            run(signals, "signals", file_sink("signals", f"{folder}/signals"), folder)
    emitted = spark.read.parquet(f"{folder}/signals")
    everything = clean_quotes(decode_messages(read_messages(spark, "parquet", path=f"{folder}/messages", streaming=False)))
    closed = START + timedelta(seconds=seconds[-1] - 1)
    wanted = gen_signal(everything).where(F.col("timestamp") <= F.lit(closed))
    columns = ["ticker_symbol", "timestamp", "regular_market_price", F.round("moving_avg_price", 6), F.round("rsi", 6), "rsi_signal", "mac_signal"]
    emitted, wanted = emitted.select(*columns), wanted.select(*columns)
    assert emitted.count() == wanted.count() == 89
    assert emitted.exceptAll(wanted).isEmpty() and wanted.exceptAll(emitted).isEmpty()


def test_panes_in_a_stream_give_the_same_windows(spark, folder):
    lay_down(spark, message_rows(range(0, 400, 3)), folder)
    found = {}
    with session_settings(spark, service.stateful_settings(2)):
        for name, panes in (("direct", False), ("panes", True)):
            signals = gen_signal(quotes_of(spark, folder), 60, 10, watermark="1 second", use_panes=panes)
            run(signals, name, file_sink(name, f"{folder}/{name}"), folder)
            rows = spark.read.parquet(f"{folder}/{name}").orderBy("timestamp").collect()
            found[name] = [(row.timestamp, row.regular_market_price, round(row.moving_avg_price, 6)) for row in rows]
    assert len(found["direct"]) > 30
    # Two stateful steps: a window needs the watermark to pass the pane step's output as well.
    assert found["panes"] == found["direct"][: len(found["panes"])] and len(found["panes"]) >= len(found["direct"]) - 1


def test_late_quotes_are_dropped_and_counted(spark, folder):
    with session_settings(spark, service.stateful_settings(2)):
        for rows in (message_rows(range(0, 600, 5)), message_rows(range(600, 700, 5), 1000), message_rows([30, 40], 2000, price=lambda s: 9999.0)):
            lay_down(spark, rows, folder)
            signals = gen_signal(quotes_of(spark, folder), 60, 10, watermark="1 second")
            query = run(signals, "signals", file_sink("signals", f"{folder}/signals"), folder)
    dropped = sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)
    assert dropped > 0
    assert spark.read.parquet(f"{folder}/signals").where("moving_avg_price > 1000").isEmpty()


def test_fan_out_writes_every_sink_and_a_repeated_batch_replaces_itself(spark, folder, sf_dir):
    quotes = clean_quotes(samples.raw_quotes(spark, sf_dir))
    sinks = [
        file_sink("topic", f"{folder}/topic", fmt="json", topic=CLEAN_TOPIC),
        file_sink("collection", f"{folder}/collection", by_date=True),
    ]
    write = fan_out(sinks)
    for _ in range(2):
        write(quotes, 7)
    n = quotes.count()
    assert spark.read.json(f"{folder}/topic").count() == n
    stored = spark.read.parquet(f"{folder}/collection")
    assert stored.count() == n and {"batch_id", "date"} <= set(stored.columns)
    write(quotes.limit(5), 8)
    assert spark.read.parquet(f"{folder}/collection").count() == n + 5
    day = stored.where("date = date'2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


def test_a_query_resumes_from_its_own_checkpoint(spark, folder):
    for step in range(3):
        lay_down(spark, message_rows(range(step * 10, step * 10 + 10), step * 10), folder)
        run(quotes_of(spark, folder), "clean", file_sink("clean", f"{folder}/clean"), folder)
        ids = sorted(row.event_id for row in spark.read.parquet(f"{folder}/clean").collect())
        assert ids == list(range(step * 10 + 10))


def full_quotes(spark, n, first=0):
    """Stream-shaped quotes with all features, by ticker and second."""
    rows = spark.range(first, first + n).select(
        F.when(F.col("id") % 3 == 0, F.lit("B")).otherwise(F.lit("A")).alias("ticker_symbol"),
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id")).alias("timestamp"),
        F.col("id").alias("event_id"),
        *[(F.lit(100.0 + i) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 100).alias(name) for i, name in enumerate(FEATURES)],
    )
    return rows


def test_training_and_scoring_batches(spark, folder):
    store = ml.ModelStore(spark, f"{folder}/models")
    train = service.train_on_batch(store)
    score = service.score_batch(store, [file_sink("ols", f"{folder}/ols")])
    score(full_quotes(spark, 50), 0)
    train(full_quotes(spark, 8), 0)
    assert store.newest_version() is None, "no row has a label yet, so there is no model and no score"
    train(full_quotes(spark, 200), 1)
    assert store.newest_version() == 1
    train(full_quotes(spark, 5), 2)
    assert store.newest_version() == 1, "a batch without labels keeps the model"
    for _ in range(2):
        score(full_quotes(spark, 50), 5)
    rows = spark.read.parquet(f"{folder}/ols").collect()
    assert sorted(row.ticker_symbol for row in rows) == ["A", "B"] and {row.batch_id for row in rows} == {5}
    assert {row.ols_signal for row in rows} <= {-1, 0, 1}


def test_training_on_stored_quotes(spark, folder):
    quotes = full_quotes(spark, 7200)
    assert service.recent_history(quotes, f"{folder}/clean", minutes=10).count() == 7200, "nothing is stored yet"
    fan_out([file_sink("clean", f"{folder}/clean", by_date=True)])(quotes, 0)
    recent = service.recent_history(quotes.where("event_id < 5000"), f"{folder}/clean", minutes=10)
    ids = recent.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    assert tuple(ids) == (4400, 4999, 600)
    store = ml.ModelStore(spark, f"{folder}/models")
    service.train_on_batch(store, history=f"{folder}/clean", minutes=10)(full_quotes(spark, 3, 6000), 4)
    assert store.newest_version() == 4


def test_service_starts_named_queries_and_stops_on_the_first_failure(spark, folder):
    lay_down(spark, message_rows(range(50)), folder)

    class Broken(Sink):
        def write_batch(self, rows, batch_id):
            raise RuntimeError("sink is down")

    running = service.Service(
        quotes=quotes_of(spark, folder),
        checkpoints=f"{folder}/checkpoints",
        models=ml.ModelStore(spark, f"{folder}/models"),
        quote_sinks=[Broken("broken", "parquet")],
        signal_sinks=[file_sink("signals", f"{folder}/signals", topic=SIGNAL_TOPIC)],
        ols_sinks=[file_sink("ols", f"{folder}/ols")],
        state_settings=service.stateful_settings(2),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(Exception, match="sink is down"):
        service.run_until_failure(spark, running)
    assert spark.streams.active == [] and spark.conf.get("spark.sql.shuffle.partitions") == before
    spark.streams.resetTerminated()


def test_sink_settings(monkeypatch):
    topic = topic_sink("host:9092", CLEAN_TOPIC)
    assert topic.fmt == "kafka" and topic.options == {"kafka.bootstrap.servers": "host:9092", "topic": CLEAN_TOPIC}
    monkeypatch.delenv("TICKLOOM_DOCUMENT_URI", raising=False)
    with pytest.raises(KeyError):
        collection_sink("stock", "signal-ols")
    monkeypatch.setenv("TICKLOOM_DOCUMENT_URI", "scheme://somewhere")
    options = collection_sink("stock", "signal-ols").options
    assert options["spark.mongodb.connection.uri"] == "scheme://somewhere"
    assert options["spark.mongodb.collection"] == "signal-ols"
    assert console_sink().options == {"truncate": "false"}
    with pytest.raises(ValueError):
        file_sink("x", "y", topic=CLEAN_TOPIC, by_date=True)


def test_console_sink_runs(spark, folder):
    lay_down(spark, message_rows(range(3)), folder)
    run(quotes_of(spark, folder).select("ticker_symbol"), "console", console_sink(), folder)


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
